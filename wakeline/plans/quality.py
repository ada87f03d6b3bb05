"""Trace quality, chart tables, result index and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from .metrics import q6

MAX_LLM_FAILURE = 0.10


def llm_health(events: DataFrame) -> DataFrame:
    """Calls and failures of each run; the presence of an error key is the failure."""
    ends = events.filter("type = 'message_end'")
    failed = F.count_if(F.coalesce("has_error_key", F.lit(False)))
    return ends.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), failed.alias("failed")).withColumn("rate", q6(F.try_divide("failed", "calls"))).withColumn("ok", F.coalesce(F.col("rate") <= MAX_LLM_FAILURE, F.lit(False)))


def quality_report(fs: DataFrame) -> DataFrame:
    """Shares of attributed events, of data calls with an offset, and of known paths."""
    data = C.is_data(F.col("syscall"))
    return fs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), q6(F.avg(F.col("tool_call").isNotNull().cast("int"))).alias("attributed"), q6(F.avg(F.col("path").isNotNull().cast("int"))).alias("with_path"),
        q6(F.try_divide(F.count_if(data & F.col("offset").isNotNull()), F.count_if(data))).alias("with_offset"),
    )


def describe(report: DataFrame) -> DataFrame:
    """One line of text for each run."""
    pct = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    return report.select("run_id", F.concat(F.col("events").cast("string"), F.lit(" events, "), pct("attributed"), F.lit(" attributed, "), pct("with_offset"), F.lit(" with offsets")).alias("line"))


def io_rate(fs: DataFrame) -> DataFrame:
    """Bytes by kind in bins of 1, 2 or 5 seconds by the run's duration."""
    t = F.col("ts_ms") / 1000
    w = Window.partitionBy("run_id")
    ops = fs.filter(F.col("syscall").isin(C.READS + C.WRITES)).select("run_id", t.alias("t"), C.kind(F.col("syscall")).alias("kind"), "bytes_transferred", F.min(t).over(w).alias("t0"), F.max(t).over(w).alias("t1"))
    span = F.col("t1") - F.col("t0")
    width = F.when(span <= 120, 1.0).when(span <= 600, 2.0).otherwise(5.0)
    return ops.groupBy("run_id", "kind", F.floor((F.col("t") - F.col("t0")) / width).alias("bin"), width.alias("width_s")).agg(F.sum("bytes_transferred").alias("bytes"))


def volume_opens_histogram(files: DataFrame, decades: int = 12) -> DataFrame:
    """Files by decade of their bytes and number of opens."""
    decade = F.least(F.lit(decades), F.floor(F.log10(F.col("r") + F.col("w"))))
    return files.groupBy("run_id", decade.cast("int").alias("decade"), F.least("opens", F.lit(10)).alias("opens")).agg(F.count(F.lit(1)).alias("files"))


def input_size_ecdf(sizes: DataFrame, axis: str = "axis") -> DataFrame:
    """Empirical distribution of input sizes along one axis of cells."""
    w = Window.partitionBy(axis).orderBy("size")
    return sizes.select(axis, "size", q6(F.cume_dist().over(w)).alias("share")).distinct()


def scaling_series(cells: DataFrame) -> DataFrame:
    """Unique and read input of each cell relative to the first cell of its series."""
    w = Window.partitionBy("series").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rel = lambda c: q6(F.try_divide(F.col(c), F.first(c).over(w))).alias(f"{c}_rel")
    return cells.select("series", "cell", "unique_bytes", "read_bytes", rel("unique_bytes"), rel("read_bytes"))


RUN_NAME = r"^(\d{8}_\d{6})(?:[-_](.*))?$"


def task_rows(cells: DataFrame) -> DataFrame:
    """Stamp and label of run names; names without a stamp are labels."""
    stamp = F.regexp_extract("run", RUN_NAME, 1)
    return cells.select("*", F.nullif(stamp, F.lit("")).alias("stamp"), F.when(stamp != "", F.regexp_extract("run", RUN_NAME, 2)).otherwise(F.col("run")).alias("label"))
