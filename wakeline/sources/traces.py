"""Readers of trace directories.

A trace directory is ``<root>/<run>/<cell>/``; every reader takes a path or glob and
adds ``run`` and ``cell`` from each file's path.  Schemas are given, never inferred;
malformed lines are dropped.  ``pos`` is a line's place in its file, taken from the
reader's row index, so that "first" and "last" keep their meaning in parallel.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..functions import classify as C

_CELL = r"([^/]+)/([^/]+)/[^/]+$"


def _located(df: DataFrame) -> DataFrame:
    file = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(file, _CELL, 1).alias("run"), F.regexp_extract(file, _CELL, 2).alias("cell"), (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("pos"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = _located(spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.filter("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in schema else df


def read_events(spark: SparkSession, path: str, window_ns: int = 1_000_000_000) -> DataFrame:
    """Kernel and library events in time order per cell.  An event that comes more than the window
    after a later one in its file fails the job, as its trace is damaged."""
    df = read_jsonl(spark, path, schemas.RAW_EVENTS).filter("type <> 'meta' and ts_ns is not null")
    seen = F.max("ts_ns").over(Window.partitionBy("run", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    late = F.coalesce(seen - F.col("ts_ns") > window_ns, F.lit(False))
    checked = F.when(late, F.raise_error(F.lit("event later than the reorder window")).cast("bigint")).otherwise(F.col("ts_ns"))
    return df.withColumn("ts_ns", checked).withColumn("seq", F.row_number().over(Window.partitionBy("run", "cell").orderBy("ts_ns", "pos")))


def read_event_meta(spark: SparkSession, path: str) -> DataFrame:
    """The first meta record of each cell."""
    meta = read_jsonl(spark, path, schemas.RAW_EVENTS).filter("type = 'meta'")
    return meta.groupBy("run", "cell").agg(F.min_by(F.struct("wall_start_ns", "mono_start_ns", "root_pid"), "pos").alias("m")).select("run", "cell", "m.*")


TOOL_LINE = r"^\[(\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:\s*->\s*(\d{2}:\d{2}:\d{2}(?:\.\d+)?))?\]\s*(?:\(([\d.]+)\s*ms\)\s*)?(\S+)\s*\(id=([^)]*)\)\s*input=(.*)$"


@F.pandas_udf(T.StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """Python literals as JSON; anything else as {"raw": text}; an Arrow batch at a time."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(ast.literal_eval(text), default=str)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return json.dumps({"raw": text})

    return texts.map(one, na_action="ignore")


def day_ms(clock: Column, date: str) -> Column:
    """Milliseconds of a time of day on the trace's date; fractions are padded to microseconds."""
    padded = F.concat(F.substring(clock, 1, 8), F.lit("."), F.rpad(F.regexp_extract(clock, r"\.(\d+)$", 1), 6, "0"))
    return F.unix_micros(F.to_timestamp(F.concat(F.lit(f"{date} "), padded), "yyyy-MM-dd HH:mm:ss.SSSSSS")) / 1000.0


def read_tool_log(spark: SparkSession, path: str, date: str, drop_task: bool = True) -> DataFrame:
    """Tool calls of text logs: id, name, start, end, duration and input (JSON text)."""
    lines = _located(spark.read.text(path)).filter(F.col("value").rlike(TOOL_LINE))
    part = lambda i: F.nullif(F.regexp_extract("value", TOOL_LINE, i), F.lit(""))
    out = lines.select("run", "cell", "pos", day_ms(part(1), date).alias("s"), day_ms(part(2), date).alias("e0"), part(3).cast("double").alias("duration_ms"), part(4).alias("tool_name"), part(5).alias("tool_id"), literal_json(part(6)).alias("input"))
    out = out.withColumn("e", F.coalesce("e0", F.col("s") + F.col("duration_ms"), "s")).drop("e0")
    # a log that runs past midnight
    out = out.withColumn("e", F.when(F.col("e") < F.col("s"), F.col("e") + 86_400_000).otherwise(F.col("e")))
    return out.filter("tool_name <> 'Task'") if drop_task else out


def read_agent_events(spark: SparkSession, path: str) -> DataFrame:
    """Agent events with ``has_error_key``: a failed call is known by the key, whatever its value."""
    raw = _located(spark.read.text(path)).withColumn("_v", F.from_json("value", schemas.AGENT_EVENTS, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    keys = F.json_object_keys("value")
    out = raw.filter("_v._corrupt_record is null and _v.type is not null").select("_v.*", "cell", "run", "pos", F.array_contains(keys, "error").alias("has_error_key"))
    return out.drop("_corrupt_record")


def phase_index(events: DataFrame) -> DataFrame:
    """Per call the last value of phase, role, tool, layers and cache key that is not null."""
    names = {"phase": "phase", "role": "agent_role", "tool": "tool_name", "layers": "io_layers", "cache_key": "cache_key"}
    return events.filter("run_id is not null").groupBy("run", "cell", "run_id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos"))).alias(a) for a, c in names.items()))


def llm_calls(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Calls joined from events and messages: the last event of a type wins; failed and unmatched calls are dropped."""
    when = lambda t, v: F.max_by(v, F.when(F.col("type") == t, F.col("pos")))
    ts, use = F.coalesce("message.timestamp", "timestamp"), F.col("message.usage")
    calls = events.filter("run_id is not null").groupBy("run", "cell", "run_id").agg(
        F.coalesce(when("message_start", ts), when("message_request_start", ts)).alias("s"), when("message_first_token", ts).alias("first_token"), when("message_end", ts).alias("e"), when("message_end", use).alias("usage"),
        F.max(F.coalesce(F.length("error") > 0, F.lit(False))).alias("failed"), F.max_by("cache_key", F.when(F.col("cache_key").isNotNull(), F.col("pos"))).alias("cache_key"),
    )
    sent = messages.groupBy("run", "cell", "run_id").agg(F.max_by("messages", "pos").alias("messages"), F.max_by(F.coalesce("agent_role", "genomas_role"), "pos").alias("role"), F.max_by("phase", "pos").alias("phase"))
    ok = calls.filter("not failed and e is not null").join(sent, ["run", "cell", "run_id"])
    return ok.select("run", "cell", "run_id", "role", "phase", "s", "first_token", "e", "cache_key", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), F.col("usage.cacheRead").alias("cache_read"), serialize(F.col("messages")).alias("prompt"))


def serialize(messages: Column) -> Column:
    """Messages as one text, each ``<|role|>``, a line break, its content, a line break."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("")), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n"))), "")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.MESSAGES)


def read_generated_code(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.GENERATED_CODE)


def read_llm_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.LLM_CACHE)


def read_execution_units(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.EXECUTION_UNITS).filter("execution_unit_id <> ''").withColumnsRenamed({"start_ts_ms": "s", "end_ts_ms": "e"})


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTIFACTS).option("header", True).csv(path)


def read_fs_entries(spark: SparkSession, path: str) -> DataFrame:
    """The fact table inside parsed trace files (one JSON document each)."""
    doc = T.StructType([T.StructField("fs_entries", T.ArrayType(T.StructType.fromDDL(schemas.FS_ENTRIES)))])
    return _located(spark.read.schema(doc).option("multiLine", True).json(path)).select("run", "cell", F.explode("fs_entries").alias("x")).select("run", "cell", "x.*")


COUNTER = r"^([A-Za-z_:][\w:]*)(?:\{([^}]*)\})?\s+([-+0-9.eE]+)$"


def read_prometheus(spark: SparkSession, path: str) -> DataFrame:
    """(run, cell, file, metric, labels, value) of Prometheus text."""
    lines = _located(spark.read.text(path)).withColumn("file", F.col("_metadata.file_name"))
    ok = lines.filter(~F.col("value").startswith("#") & F.col("value").rlike(COUNTER))
    labels = F.transform(F.regexp_extract_all(F.regexp_extract("value", COUNTER, 2), F.lit(r'(\w+="[^"]*")'), 1), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_extract(p, '="([^"]*)"', 1).alias("v")))
    return ok.select("run", "cell", "file", F.regexp_extract("value", COUNTER, 1).alias("metric"), F.map_from_entries(labels).alias("labels"), F.regexp_extract("value", COUNTER, 3).cast("double").alias("number"))


def prefix_cache_counters(metrics: DataFrame) -> DataFrame:
    """Queries and hits of the prefix cache by file."""
    name = F.col("metric")
    return metrics.groupBy("run", "cell", "file").agg(F.sum(F.when(name.rlike("prefix_cache_queries(_total)?$"), F.col("number"))).cast("long").alias("queries"), F.sum(F.when(name.rlike("prefix_cache_hits(_total)?$"), F.col("number"))).cast("long").alias("hits"))


def cache_config(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("metric").rlike("cache_config_info$")).select("run", "cell", F.explode("labels").alias("key", "value")).distinct()


def read_file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of staged input files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))


def discover_cells(spark: SparkSession, root: str, file: str = "manifest.json") -> DataFrame:
    """(run, cell, path) of every cell that holds the file."""
    found = spark.read.format("binaryFile").load(f"{root}/*/*/{file}").select("path")
    return found.select(F.regexp_extract("path", _CELL, 1).alias("run"), F.regexp_extract("path", _CELL, 2).alias("cell"), F.regexp_replace("path", "/[^/]*$", "").alias("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _located(spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)).drop("pos")


def read_server_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, tokens, token_strs) from one JSON object per file, keyed by call."""
    doc = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<tokens:array<int>,token_strs:array<string>>>"
    return doc.select(F.explode(F.from_json("value", kind)).alias("run_id", "v")).select("run_id", "v.*")


def bytes_of_surface(strings: DataFrame, column: str = "token_strs") -> DataFrame:
    """Byte-level BPE surface strings decoded to text (``text``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
        for b in batches:
            out = [None if t is None else bytes(back.get(c, 63) for s in t for c in s).decode("utf-8", "replace") for t in b.column(column).to_pylist()]
            yield b.append_column("text", pa.array(out, pa.string()))

    return strings.mapInArrow(run, T.StructType([*strings.schema.fields, T.StructField("text", T.StringType())]))


def to_fs_entries(events: DataFrame, wall_offset_ns: Column | None = None) -> DataFrame:
    """Raw system-call events as fact rows: bytes, sizes, offsets, flags, errno."""
    call, ret = F.col("syscall"), F.col("ret")
    data = C.is_data(call)
    count = F.when(data, F.col("arg2")).cast("bigint")
    wall = F.col("ts_ns") + (wall_offset_ns if wall_offset_ns is not None else F.lit(0))
    signed = F.when(F.col("arg0") >= F.lit("9223372036854775808").cast("decimal(20,0)"), F.col("arg0") - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("arg0")).cast("bigint")
    return events.filter("type = 'syscall'").select(
        "run", "cell", "pos", "pid", "tid", (wall / 1e6).alias("ts_ms"), call.alias("syscall"), ret.alias("return_value"), (F.col("latency_ns") / 1e9).alias("dur_s"), "path",
        F.when(data & (ret > 0), ret).otherwise(0).alias("bytes_transferred"), count.alias("requested_size"), F.when(data & (ret >= 0), ret).alias("actual_size"),
        F.col("file_offset").alias("offset"), "offset_src", signed.cast("int").alias("fd"), F.when(call == "openat", C.open_flags(F.col("arg2").cast("bigint"))).alias("open_flags"),
        F.when(ret < 0, -ret).cast("int").alias("errno"), C.resource_bucket(call).alias("resource_bucket"),
    )


def delta_usage(events: DataFrame) -> DataFrame:
    """Streamed deltas by call: counts, characters, white-space token estimates and the text in order."""
    text = F.coalesce("assistantMessageEvent.delta", F.lit(""))
    words = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"\S+")))
    return events.filter("type = 'message_delta'").groupBy("run", "cell", "run_id", F.coalesce("delta_type", "assistantMessageEvent.type").alias("delta_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("delta_chars", F.length(text))).alias("chars"), F.sum(F.coalesce("delta_tokens_est", words)).alias("tokens"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "").alias("text"),
    )
