"""Structured Streaming forms: reorder check, fixed bins, bursts, start-end pairing, repeat guard, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Files of JSON lines as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def binned_bytes(events: DataFrame, window: str = "60 seconds", late: str = "1 second") -> DataFrame:
    """Bytes per run and fixed window (ts TIMESTAMP, run_id, bytes); later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy("run_id", F.window("ts", window)).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("ops")).select("run_id", F.col("window.start").alias("start"), "bytes", "ops")


def bursts(events: DataFrame, gap: str = "10 seconds", late: str = "1 second") -> DataFrame:
    """Sessions of I/O by idle gap.  Approximate: the gap counts from event to event, not from the latest end."""
    return events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("ops"), F.sum("bytes").alias("bytes")).select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "ops", "bytes")


def pair(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Calls from a stream of starts (run_id, id, s) and one of ends (run_id, id, e)."""
    a = starts.withWatermark("s", late).alias("a")
    b = ends.withWatermark("e", late).alias("b")
    return a.join(b, F.expr(f"a.run_id = b.run_id and a.id = b.id and b.e >= a.s and b.e <= a.s + interval {within}")).select("a.run_id", "a.id", "a.s", "b.e")


class _Reorder(StatefulProcessor):
    """Marks events that come more than the window after a later one of their run."""

    def __init__(self, window_ns: int) -> None:
        self.window = window_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "ts_ns long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        top = self.top.get()[0] if self.top.exists() else -(1 << 62)
        for df in rows:
            seen = df["ts_ns"].cummax().shift(fill_value=top).clip(lower=top)
            top = max(top, int(df["ts_ns"].max()))
            yield pd.DataFrame({"run_id": key[0], "ts_ns": df["ts_ns"], "late": seen - df["ts_ns"] > self.window})
        self.top.update((top,))

    def close(self) -> None:
        pass


def mark_late(events: DataFrame, window_ns: int = 1_000_000_000) -> DataFrame:
    """(run_id, ts_ns, late): every event, the late ones marked so that a sink can fail or set them aside."""
    kind = events.schema["run_id"].dataType.simpleString()
    return events.select("run_id", "ts_ns").groupBy("run_id").transformWithStateInPandas(_Reorder(window_ns), f"run_id {kind}, ts_ns long, late boolean", "Append", "None")


class _Repeats(StatefulProcessor):
    """Length of the run of equal prompts of each run, one row when it reaches the limit."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "key string, n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n = self.state.get() if self.state.exists() else (None, 0)
        for df in rows:
            hit = []
            for call, k in df.sort_values("call")[["call", "cache_key"]].itertuples(index=False):
                last, n = k, n + 1 if k == last else 1
                if n >= self.limit:
                    hit.append((key[0], call, n))
            yield pd.DataFrame(hit, columns=["run_id", "call", "repeats"])
        self.state.update((last, n))

    def close(self) -> None:
        pass


def repeat_guard(calls: DataFrame, limit: int = 20) -> DataFrame:
    kind = calls.schema["run_id"].dataType.simpleString()
    return calls.select("run_id", "call", "cache_key").groupBy("run_id").transformWithStateInPandas(_Repeats(limit), f"run_id {kind}, call long, repeats int", "Append", "None")


def counter_deltas(readings: DataFrame, late: str = "1 minute") -> DataFrame:
    """Growth of each counter over fixed minutes (ts, run_id, metric, number)."""
    w = F.window("ts", "1 minute")
    return readings.withWatermark("ts", late).groupBy("run_id", "metric", w).agg((F.max("number") - F.min("number")).alias("delta")).select("run_id", "metric", F.col("window.start").alias("start"), "delta")
