"""Report edge: sinks, text trees, merged run rows and the staged run.

Only aggregated frames reach the driver here (call trees and report tables of one run).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..operators import intervals as I
from .metrics import q6


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = ["run_id"]) -> None:
    """Writes a result as parquet, json or csv, partitioned by run."""
    df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns]).format(kind).option("header", True).save(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a Markdown table; an error where it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table to read; write() takes them")
    cell = lambda v: "–" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def call_tree(events: DataFrame, run_id: object) -> str:
    """The calls of one run as an indented text, children by start."""
    below: dict[str | None, list] = {}
    for r in events.filter(F.col("run_id") == run_id).orderBy("s", "e", "id").select("id", "parent", "kind", "s", "e").collect():
        below.setdefault(r["parent"], []).append(r)
    out: list[str] = []
    stack = [(r, 0) for r in reversed(below.get(None, []))]
    while stack:
        r, depth = stack.pop()
        out.append(f"{'  ' * depth}{r['id']} [{r['kind']}] {(r['e'] - r['s']) / 1000:.3f} s")
        stack += [(c, depth + 1) for c in reversed(below.get(r["id"], []))]
    return "\n".join(out)


def call_dot(events: DataFrame, sequence: DataFrame, run_id: object) -> str:
    """The calls of one run as a Graphviz graph: parents solid, order dashed."""
    rows = events.filter(F.col("run_id") == run_id).orderBy("id").select("id", "parent", "kind").collect()
    order = sequence.filter(F.col("run_id") == run_id).orderBy("a", "b").select("a", "b").collect()
    lines = [f'  "{r["id"]}" [shape={"box" if r["kind"] == "tool" else "ellipse"}];' for r in rows]
    lines += [f'  "{r["parent"]}" -> "{r["id"]}";' for r in rows if r["parent"]] + [f'  "{r["a"]}" -> "{r["b"]}" [style=dashed];' for r in order]
    return "digraph calls {\n" + "\n".join(lines) + "\n}"


def open_segments(events: DataFrame) -> DataFrame:
    """Starts and ends by id for charts; a start without an end closes at the run's last start, not before itself."""
    by = events.groupBy("run_id", "id").agg(F.min(F.when(F.col("type") == "start", F.col("t"))).alias("s"), F.max(F.when(F.col("type") == "end", F.col("t"))).alias("e")).filter("s is not null")
    last = F.max("s").over(Window.partitionBy("run_id"))
    return by.select("run_id", "id", "s", F.coalesce("e", F.greatest("s", last)).alias("e"), F.col("e").isNull().alias("open"))


def effective_category(syscall: Column, path: Column) -> Column:
    """Category for charts; data calls without a path are waits."""
    c = C.category(syscall)
    return F.when((c == "data") & (F.coalesce(path, F.lit("")) == ""), "wait").otherwise(c)


def category_seconds(fs: DataFrame) -> DataFrame:
    """Wall seconds of each category: the union of its intervals, which end at the events' times."""
    x = fs.select("run_id", effective_category(F.col("syscall"), F.col("path")).alias("category"), (F.col("ts_ms") - F.greatest(F.lit(0.0), F.col("dur_s") * 1000)).alias("s"), F.col("ts_ms").alias("e"))
    return I.union_length(x, ["run_id", "category"]).select("run_id", "category", F.round(F.col("length") / 1000, 3).alias("seconds"))


def residue(events: DataFrame, warn: float = 5.0) -> DataFrame:
    """Share of each run's span that no call covers, and whether it is worth a warning."""
    span = events.groupBy("run_id").agg((F.max("e") - F.min("s")).alias("span"))
    busy = I.union_length(events, ["run_id"])
    pct = 100 * F.try_divide(F.col("span") - F.col("length"), "span")
    return span.join(busy, "run_id").select("run_id", F.round(pct, 3).alias("residue_pct"), (F.round(pct, 3) > warn).alias("warn"))


def tz_offset(walls: DataFrame, tools: DataFrame, step_min: int = 30) -> DataFrame:
    """Wall start minus the first tool of the log (by position), rounded to half hours (run_id, offset_ms)."""
    step = step_min * 60_000.0
    first = tools.groupBy("run_id").agg(F.min_by("s", "pos").alias("s"))
    return walls.join(first, "run_id").select("run_id", (F.bround((F.col("ws") - F.col("s")) / step, 0) * step).alias("offset_ms"))


def lib_io(events: DataFrame) -> DataFrame:
    """Library calls (libc, HDF5, MPI-IO) as facts: layer, function, bytes, whether they are known."""
    layer = F.when(F.col("type") == "libc_io", "STDIO").when(F.lower("library").contains("hdf5"), "HDF5").when(F.lower("library").contains("mpi"), "MPI-IO")
    known = F.coalesce("bytes_resolved", F.col("bytes").isNotNull())
    return events.filter(F.col("type").isin("libc_io", "lib_io")).select("run", "cell", "pos", "pid", (F.col("ts_ns") / 1e6).alias("ts_ms"), layer.alias("layer"), "function", F.coalesce("bytes", F.when(F.col("type") == "libc_io", F.col("ret"))).alias("bytes"), known.alias("known"), (F.col("latency_ns") / 1e9).alias("dur_s"))


def lifecycle_events(events: DataFrame) -> DataFrame:
    """Forks, execs and exits as facts."""
    return events.filter(F.col("type").isin("fork", "exec", "exit")).select("run", "cell", "pos", F.col("type").alias("kind"), "pid", "child_pid", (F.col("ts_ns") / 1e6).alias("ts_ms"), "path")


def code_index(calls: DataFrame, events: DataFrame, code: DataFrame) -> DataFrame:
    """Code executions enriched by events, then by code records: later sources win, nulls never do."""
    cols = ["role", "phase", "io_layers"]
    a = calls.select("run_id", "id", *(F.col(c).alias(f"{c}0") for c in cols))
    b = events.select("run_id", "id", *(F.col(c).alias(f"{c}1") for c in cols))
    c = code.select("run_id", "id", *(F.col(x).alias(f"{x}2") for x in cols))
    out = a.join(b, ["run_id", "id"], "left").join(c, ["run_id", "id"], "left")
    return out.select("run_id", "id", *(F.coalesce(f"{x}2", f"{x}1", f"{x}0").alias(x) for x in cols))


def provenance_detail(calls: DataFrame, code: DataFrame, cache: DataFrame) -> DataFrame:
    """Calls with the code they ran (by id) and the output that was cached for their prompt (by key)."""
    return calls.join(code.select("run_id", "id", "code"), ["run_id", "id"], "left").join(cache.select("cache_key", "result"), "cache_key", "left")


def cache_hit(queries_delta: Column, hits_delta: Column, prompt_tokens: Column) -> Column:
    """Hits of a counter delta that belong to one call: only if the queries equal its prompt's tokens."""
    return F.when((queries_delta == prompt_tokens) & (hits_delta >= 0), hits_delta)


def cached_tokens(reported: Column, attributed: Column) -> Column:
    """(value, available, source): an explicit 0 is a measurement, a missing value is not."""
    source = F.when(reported.isNotNull(), "response").when(attributed.isNotNull(), "counter")
    return F.struct(F.coalesce(reported, attributed).alias("value"), source.isNotNull().alias("available"), source.alias("source"))


def bundle(calls: DataFrame) -> DataFrame:
    """Requests for a replay: arrival offsets from the run's first start, completeness of each and of the run."""
    w = Window.partitionBy("run_id")
    ok = F.col("prompt").isNotNull() & (F.length("prompt") > 0)
    return calls.select("run_id", "call", q6(F.col("s") - F.min("s").over(w)).alias("offset_ms"), "input", "output", ok.alias("complete"), F.min(ok).over(w).alias("all_complete"))


def segment_samples(segments: DataFrame, n: int = 3) -> DataFrame:
    """The n longest segments of each number of calls, as samples for a report."""
    order = Window.partitionBy("run_id", "n_calls").orderBy(F.desc("tokens"), "offset", "calls")
    return segments.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("run_id", "n_calls", "rank", "tokens", "offset")


def run_row(usage: DataFrame, reuse: DataFrame, realized: DataFrame) -> DataFrame:
    """One merged row per run: calls, tokens, logical and realised reuse and the gap between them."""
    base = usage.filter("level = 3").select("run_id", "calls", "input", "output")
    out = base.join(reuse.select("run_id", F.col("share").alias("logical_share")), "run_id", "left").join(realized.select("run_id", "realized"), "run_id", "left")
    return out.select("*", q6(F.try_divide("realized", "input")).alias("realized_share"), q6(F.col("logical_share") - F.try_divide("realized", "input")).alias("gap"))


def path_config(env: list[str] | None, saved: list[str] | None, manifest: list[str] | None, default: list[str]) -> list[str]:
    """Path prefixes by precedence: environment, saved, manifest, default."""
    return next((x for x in (env, saved, manifest) if x), default)


def run_stages(spark: SparkSession, stages: list[tuple[str, list[str], Callable[[dict], DataFrame]]], root: str) -> DataFrame:
    """Runs named stages after those they need, writes each as Parquet and returns their timings.

    A failed stage fails the run; stages that need it never start."""
    done: dict[str, DataFrame] = {}
    times = []
    left = list(stages)
    while left:
        ready = [s for s in left if all(n in done for n in s[1])]
        if not ready:
            raise ValueError(f"stages wait for each other: {[s[0] for s in left]}")
        for name, _, stage in ready:
            began = time.perf_counter()
            stage(done).write.mode("overwrite").parquet(f"{root}/{name}")
            done[name] = spark.read.parquet(f"{root}/{name}")
            times.append((name, round(time.perf_counter() - began, 3)))
        left = [s for s in left if s not in ready]
    return spark.createDataFrame(times, "stage string, seconds double")
