"""Helpers shared by the operators: inputs, shared scratch tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A join side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch from which it is sent to Python, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all
    executors run inside this machine's driver."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.wakeline.scratch", None)
        if not at:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
            at = tempfile.mkdtemp(prefix="wakeline-")
            spark.conf.set("spark.wakeline.scratch", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later stages start from that
    table, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/wakeline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wakeline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote.  For tables that nothing reads any more: what was made of
    them has reached the driver or a table of its own, from which lost work starts again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._wakeline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns to the system what the allocators of Arrow and of the C library hold without use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in memory that follows neither the length of the texts nor the tasks before.

    10,000 rows, Spark's own limit, are tens of MB of texts, several times in each task: batches of
    the session end at ``BATCH_BYTES`` too.  A Python worker outlives its task, so it gives back
    what it has freed.  The rows are the same."""
    spark = df.sparkSession
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def lean_groups(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for ``applyInArrow``, after which the worker gives back what it has freed."""

    def lean(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return lean


def small_side(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast if the counted rows fit ``limit``; otherwise builds a shuffled hash side."""
    return F.broadcast(df) if df.count() * width <= limit else df.hint("shuffle_hash")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one pass over one column, a single number back."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with the columns of ``ddl`` behind."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def most_frequent(counts: DataFrame, by: str, limit: int, tie: str) -> DataFrame:
    """The ``limit`` rows with the largest counts (all rows, if there are no more), the smallest ``tie``
    first among equals.  A histogram of the counts (32 steps an octave) says which steps are in as a
    whole; only the rows of the step at the limit are sorted."""
    step = F.floor(F.log2(by) * 32)
    rows = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()
    total = 0
    for r in rows:
        if total + r["n"] > limit:
            edge = counts.filter(step == r["s"]).orderBy(F.desc(by), tie).limit(limit - total)
            return counts.filter(step > r["s"]).unionAll(edge) if total else edge
        total += r["n"]
    return counts
