"""Trace-shaped views over the test tables.

These views are scaffolding: they give the driver's synthetic ``events`` and
``conversations`` tables the schemas that real trace directories have (see
``sources.traces``), so that every query can run on them and be compared with SQL.
A *run* is one traced directory; all queries are partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fs_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per I/O event.  ``ts_ms`` is the end of the call."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    name, kind = F.col("event_type"), F.col("value")
    syscall = F.when(name == "view", "read").when(name == "purchase", "write").when(name == "click", "openat").when(name == "signup", "getdents64").otherwise("newfstatat")
    ext = F.when(k % 5 == 0, "csv").when(k % 5 == 1, "json").when(k % 5 == 2, "log").when(k % 5 == 3, "py").otherwise("ckpt")
    # two-thirds of the failed probes are an interpreter's
    path = F.when((name == "error") & (k % 3 != 0), F.concat(F.lit("/usr/lib/python3.11/site-packages/m"), k.cast("string"), F.lit(".py"))).otherwise(
        F.concat(F.lit("/work/d"), (k % 4).cast("string"), F.lit("/f"), (k % 20).cast("string"), F.lit("."), ext)
    )
    path = F.when(name == "signup", F.concat(F.lit("/work/d"), (k % 4).cast("string"))).otherwise(path)
    data = name.isin("view", "purchase")
    pid = (F.col("user_id") % 40 + 1000).cast("int")
    base = ev.select(
        F.col("event_id"), (F.col("user_id") % 40 % 8).cast("int").alias("run_id"), pid.alias("pid"), F.col("user_id").cast("int").alias("tid"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1000.0).alias("ts_ms"), (kind * 10).alias("dur_s"), syscall.alias("syscall"), path.alias("path"),
        F.when(name == "error", -2).when(data, F.floor(kind * 1024).cast("long")).otherwise(0).cast("long").alias("return_value"),
        F.when(data, F.floor(kind * 1024)).otherwise(0).cast("long").alias("bytes_transferred"),
        F.when(data, (F.floor(kind / 16) + 1) * 16384).otherwise(0).cast("long").alias("requested_size"),
        (k % 8 + 3).cast("int").alias("fd"), k.alias("k"),
    )
    stream = Window.partitionBy("run_id", "pid", "path").orderBy("ts_ms", "event_id")
    opened = F.sum(F.when(F.col("syscall") == "openat", 1).otherwise(0)).over(stream.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    base = base.withColumn("open_generation", opened)
    per_kind = Window.partitionBy("run_id", "pid", "path", "open_generation", "syscall").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    run_sum = F.coalesce(F.sum("bytes_transferred").over(per_kind), F.lit(0))
    offset = F.when(F.col("event_id") % 11 == 0, 0).when(F.col("event_id") % 7 == 0, run_sum + 4096).otherwise(run_sum).cast("long")
    hour = F.floor((F.col("ts_ms") - 1704067200000) / (6 * 3600 * 1000)).cast("long")
    return base.select(
        "*", F.when(F.col("syscall").isin("read", "write"), offset).alias("offset"), (F.col("k") % 13 == 0).alias("append"),
        C.category(F.col("syscall")).alias("category"), C.resource_bucket(F.col("syscall")).alias("resource_bucket"),
        F.concat(F.lit("t"), F.col("run_id").cast("string"), F.lit("-"), hour.cast("string")).alias("tool_call"), hour.alias("step"),
        F.when(hour % 5 == 4, "action_unit_backtrack").when(hour % 5 == 3, "planning").otherwise("code_exec").alias("phase"),
        F.concat(F.lit("role"), (F.col("pid") % 3).cast("string")).alias("role"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tool call: the six-hour steps of each run, some of them overlapping the next."""
    fs = fs_entries(spark, sf_dir)
    steps = fs.select("run_id", "step", "tool_call", "phase").distinct()
    names = F.element_at(F.array(*map(F.lit, ("CodeExec", "Read", "Bash", "Write", "SubAgent"))), (F.col("step") % 5 + 1).cast("int"))
    start = 1704067200000 + F.col("step") * (6 * 3600 * 1000)
    return steps.select(
        "run_id", F.col("tool_call").alias("tool_id"), names.alias("tool_name"), "phase", "step",
        start.cast("double").alias("s"), (start + F.when(F.col("step") % 3 == 0, 9 * 3600 * 1000).otherwise(5 * 3600 * 1000)).cast("double").alias("e"),
        F.concat(F.lit("role"), (F.col("step") % 3).cast("string")).alias("role"),
    )


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per assistant turn: the prompt is all turns before it; runs are groups of ten conversations."""
    conv = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    turns = conv.withColumns({
        "turn": F.row_number().over(order) - 1,
        "prompt": F.array_join(F.collect_list(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), ""),
    })
    run, inside = F.floor(F.col("conv_id") / 10).cast("int"), F.col("conv_id") % 10
    start = 1704067200000.0 + (inside * 7 + F.col("turn") * 11) * 1000
    took = F.length("text") * 3.0 + 500
    n_in = F.size(F.split(F.trim(F.regexp_replace("prompt", r"\s+", " ")), " "))
    return turns.filter("role = 'assistant' and turn > 0").select(
        run.alias("run_id"), F.col("conv_id"), F.col("turn").cast("int").alias("turn"), "prompt", F.col("text").alias("response"),
        start.alias("s"), (start + took).alias("e"), (start + 200 + F.length("text") % 97).alias("first_token"),
        n_in.cast("long").alias("input"), F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).cast("long").alias("output"),
        F.concat(F.lit("agent"), (F.col("conv_id") % 3).cast("string")).alias("role"),
        F.when(F.col("turn") % 4 == 1, "plan").otherwise("act").alias("phase"),
        F.sha2("prompt", 256).alias("cache_key"),
        F.floor(n_in * (F.col("turn") % 3) / 4).cast("long").alias("cache_read"),
    ).withColumn("call", (F.row_number().over(Window.partitionBy("run_id").orderBy("s", "conv_id", "turn")) - 1).cast("int"))


# ---- the same views as SQL ------------------------------------------------------------------

FS_SQL = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), fs0 AS (
  SELECT event_id, CAST(user_id % 40 % 8 AS INTEGER) AS run_id, CAST(user_id % 40 + 1000 AS INTEGER) AS pid, CAST(user_id AS INTEGER) AS tid,
    epoch_us(ts) / 1000.0::DOUBLE AS ts_ms, value * 10 AS dur_s,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'openat' WHEN 'signup' THEN 'getdents64' ELSE 'newfstatat' END AS syscall,
    CASE WHEN event_type = 'signup' THEN '/work/d' || (k % 4)
         WHEN event_type = 'error' AND k % 3 <> 0 THEN '/usr/lib/python3.11/site-packages/m' || k || '.py'
         ELSE '/work/d' || (k % 4) || '/f' || (k % 20) || '.' || CASE k % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'log' WHEN 3 THEN 'py' ELSE 'ckpt' END END AS path,
    CASE WHEN event_type = 'error' THEN -2 WHEN event_type IN ('view', 'purchase') THEN CAST(floor(value * 1024) AS BIGINT) ELSE 0 END AS return_value,
    CASE WHEN event_type IN ('view', 'purchase') THEN CAST(floor(value * 1024) AS BIGINT) ELSE 0 END AS bytes_transferred,
    CASE WHEN event_type IN ('view', 'purchase') THEN (CAST(floor(value / 16) AS BIGINT) + 1) * 16384 ELSE 0 END AS requested_size,
    k % 8 + 3 AS fd, k
  FROM ev
), fs1 AS (
  SELECT *, CAST(sum(CASE WHEN syscall = 'openat' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, pid, path ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS open_generation FROM fs0
), fs2 AS (
  SELECT *, coalesce(sum(bytes_transferred) OVER (PARTITION BY run_id, pid, path, open_generation, syscall ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rs,
    CAST(floor((ts_ms - 1704067200000) / 21600000) AS BIGINT) AS step FROM fs1
), fs AS (
  SELECT *, CASE WHEN syscall IN ('read', 'write') THEN CAST(CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 7 = 0 THEN rs + 4096 ELSE rs END AS BIGINT) END AS "offset",
    k % 13 = 0 AS append,
    CASE syscall WHEN 'read' THEN 'data' WHEN 'write' THEN 'data' WHEN 'openat' THEN 'control' ELSE 'metadata' END AS category, 'file_io' AS resource_bucket,
    't' || run_id || '-' || step AS tool_call,
    CASE step % 5 WHEN 4 THEN 'action_unit_backtrack' WHEN 3 THEN 'planning' ELSE 'code_exec' END AS phase, 'role' || (pid % 3) AS role
  FROM fs2
)"""

TOOLS_SQL = """
tools AS (
  SELECT DISTINCT run_id, tool_call AS tool_id, CASE step % 5 WHEN 0 THEN 'CodeExec' WHEN 1 THEN 'Read' WHEN 2 THEN 'Bash' WHEN 3 THEN 'Write' ELSE 'SubAgent' END AS tool_name, phase, step,
    CAST(1704067200000 + step * 21600000 AS DOUBLE) AS s, CAST(1704067200000 + step * 21600000 + CASE WHEN step % 3 = 0 THEN 32400000 ELSE 18000000 END AS DOUBLE) AS e,
    'role' || (step % 3) AS role
  FROM fs
)"""

LLM_SQL = r"""
cv AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS t,
    string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt
  FROM conversations
), llm0 AS (
  SELECT CAST(conv_id // 10 AS INTEGER) AS run_id, conv_id, CAST(t AS INTEGER) AS turn, prompt, text AS response,
    1704067200000.0::DOUBLE + (conv_id % 10 * 7 + t * 11) * 1000 AS s, 1704067200000.0::DOUBLE + (conv_id % 10 * 7 + t * 11) * 1000 + length(text) * 3.0::DOUBLE + 500 AS e,
    1704067200000.0::DOUBLE + (conv_id % 10 * 7 + t * 11) * 1000 + 200 + length(text) % 97 AS first_token,
    CAST(len(string_split(trim(regexp_replace(prompt, '\s+', ' ', 'g')), ' ')) AS BIGINT) AS "input",
    CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS BIGINT) AS "output",
    'agent' || (conv_id % 3) AS role, CASE WHEN t % 4 = 1 THEN 'plan' ELSE 'act' END AS phase, sha256(prompt) AS cache_key
  FROM cv WHERE role = 'assistant' AND t > 0
), llm AS (
  SELECT *, CAST("input" * (turn % 3) // 4 AS BIGINT) AS cache_read, CAST(row_number() OVER (PARTITION BY run_id ORDER BY s, conv_id, turn) - 1 AS INTEGER) AS call FROM llm0
)"""
