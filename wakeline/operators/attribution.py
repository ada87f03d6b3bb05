"""Attribution of events to tool calls and execution units by interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import range_join

FILE_TOOLS = ("Read", "Write", "Edit")


def active_tools(events: DataFrame, tools: DataFrame, width_ms: float = 3_600_000.0) -> DataFrame:
    """(run_id, event_id, ...tool columns): the tools whose window holds the event, both ends included."""
    spans = tools.select("run_id", "tool_id", "tool_name", F.col("s").alias("tool_s"), F.col("e").alias("tool_e"), *(["file_path"] if "file_path" in tools.columns else []))
    return range_join(events, spans, ["run_id"], width_ms, "ts_ms", "tool_s", "tool_e")


def attribute(events: DataFrame, tools: DataFrame, width_ms: float = 3_600_000.0) -> DataFrame:
    """(run_id, event_id, tool_id, signal, n_active): the tool that each event belongs to.

    In this order: the descriptor's owner (``fd_tool``), the process's root tool where
    nothing is active, the only active tool, a file tool whose path fits, the root tool
    if active, the only active Bash for execve and clone, the tool that started last
    (then the largest id).  Columns fd_tool and root_tool may be missing.
    """
    for c in ("fd_tool", "root_tool"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    tools = tools if "file_path" in tools.columns else tools.withColumn("file_path", F.lit(None).cast("string"))
    ev = events.select("run_id", "event_id", "ts_ms", "syscall", "path", "fd_tool", "root_tool")
    pairs = active_tools(ev.filter("fd_tool is null"), tools, width_ms)
    wanted = F.rtrim(F.ltrim("file_path", F.lit("./")), F.lit("/"))
    own = F.rtrim("path", F.lit("/"))
    fits = F.col("tool_name").isin(*FILE_TOOLS) & (F.length("file_path") > 0) & ((own == wanted) | own.endswith(F.concat(F.lit("/"), wanted)))
    bash = F.col("tool_name") == "Bash"
    seen = pairs.groupBy("run_id", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("tool_id").alias("any"), F.min(F.when(fits, F.struct("tool_s", "tool_id"))).alias("file"),
        F.bool_or(F.coalesce(F.col("tool_id") == F.col("root_tool"), F.lit(False))).alias("root_active"),
        F.count_if(bash).alias("n_bash"), F.max(F.when(bash, F.col("tool_id"))).alias("bash"), F.max(F.struct("tool_s", "tool_id")).alias("last"),
    )
    x = ev.join(seen, ["run_id", "event_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none, spawn = F.col("n") == 0, F.col("syscall").isin("execve", "clone") & (F.col("n_bash") == 1)
    by = (
        F.when(F.col("fd_tool").isNotNull(), F.struct(F.lit("descriptor").alias("signal"), F.col("fd_tool").alias("tool_id")))
        .when(none, F.struct(F.when(F.col("root_tool").isNotNull(), "ancestry").otherwise("none").alias("signal"), F.col("root_tool").alias("tool_id")))
        .when(F.col("n") == 1, F.struct(F.lit("only_active").alias("signal"), F.col("any").alias("tool_id")))
        .when(F.col("file").isNotNull(), F.struct(F.lit("file_path").alias("signal"), F.col("file.tool_id").alias("tool_id")))
        .when(F.col("root_active"), F.struct(F.lit("active_ancestry").alias("signal"), F.col("root_tool").alias("tool_id")))
        .when(spawn, F.struct(F.lit("only_bash").alias("signal"), F.col("bash").alias("tool_id")))
        .otherwise(F.struct(F.lit("last_started").alias("signal"), F.col("last.tool_id").alias("tool_id")))
    )
    return x.select("run_id", "event_id", by["tool_id"].alias("tool_id"), by["signal"].alias("signal"), F.col("n").alias("n_active"))


def clip(events: DataFrame, tools: DataFrame, workspace: str | None = None) -> DataFrame:
    """Events inside [first tool start, last tool end], of the workspace where a path is known."""
    wall = tools.groupBy("run_id").agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
    out = events.join(wall, "run_id").filter("ts_ms between _s and _e").drop("_s", "_e")
    return out.filter(F.col("path").isNull() | F.col("path").contains(workspace)) if workspace else out


def annotate_units(events: DataFrame, units: DataFrame, width_ms: float = 3_600_000.0) -> DataFrame:
    """events with ``execution_unit_id``: the shortest unit of the same run and process around the event."""
    spans = units.select("run_id", "pid", "execution_unit_id", F.col("s").alias("_us"), F.col("e").alias("_ue"))
    pairs = range_join(events.select("run_id", "pid", "event_id", "ts_ms"), spans, ["run_id", "pid"], width_ms, "ts_ms", "_us", "_ue")
    best = pairs.groupBy("run_id", "event_id").agg(F.min(F.struct((F.col("_ue") - F.col("_us")).alias("len"), "execution_unit_id"))["execution_unit_id"].alias("execution_unit_id"))
    return events.join(best, ["run_id", "event_id"], "left")


def clock_offset_ms(a: DataFrame, b: DataFrame, keys: list[str], step_min: int = 15) -> DataFrame:
    """Per run the median difference of two clocks over matching rows, rounded to ``step_min`` minutes."""
    step = step_min * 60_000.0
    d = a.select(*keys, F.col("t").alias("x")).join(b.select(*keys, F.col("t").alias("y")), keys)
    return d.groupBy("run_id").agg((F.bround(F.percentile(F.col("x") - F.col("y"), F.lit(0.5)) / step, 0) * step).alias("offset_ms"))


def subagents(tools: DataFrame, llm: DataFrame, pattern: str = r"(?i)agent|delegate|subagent", slack_ms: float = 0.01, width_ms: float = 3_600_000.0) -> DataFrame:
    """tools with ``is_subagent``: the name fits, or an inference starts inside the call."""
    starts = llm.select("run_id", F.col("s").alias("llm_s"))
    spans = tools.select("run_id", "tool_id", (F.col("s") - slack_ms).alias("_a"), (F.col("e") + slack_ms).alias("_z"))
    inside = range_join(starts, spans, ["run_id"], width_ms, "llm_s", "_a", "_z").select("run_id", "tool_id").distinct().withColumn("_hit", F.lit(True))
    return tools.join(inside, ["run_id", "tool_id"], "left").withColumn("is_subagent", F.coalesce("_hit", F.lit(False)) | F.col("tool_name").rlike(pattern)).drop("_hit")


def last_event_pivot(events: DataFrame, types: list[str], value: str = "t") -> DataFrame:
    """(run_id, id, one column per type): the value of the last event of each type of each call."""
    cols = [F.max_by(F.when(F.col("type") == t, F.col(value)), F.when(F.col("type") == t, F.col("pos"))).alias(t) for t in types]
    return events.groupBy("run_id", "id").agg(*cols)


def last_wins(events: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
