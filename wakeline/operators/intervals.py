"""Interval algebra over (keys..., s, e) tables with running windows.

All windows are partitioned by the keys (a run, a worker, ...), so that the work
spreads over runs; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Time that two intervals share; 0 if they are apart, null if an end is null."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)))


def islands(df: DataFrame, keys: list[str], s: str = "s", e: str = "e", gap: Column | float = 0.0, keep_empty: bool = False, strict: bool = False) -> DataFrame:
    """df with ``island``: a new one starts where the gap to everything before exceeds ``gap``.

    Touching intervals merge.  Empty intervals are dropped unless ``keep_empty``.
    """
    order = Window.partitionBy(*keys).orderBy(s, e)
    if not keep_empty:
        df = df.filter(F.col(e) > F.col(s))
    before = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_reach", before)
    new = F.col("_reach").isNull() | (F.col(s) - F.col("_reach") > gap)
    return df.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach")


def merged(df: DataFrame, keys: list[str], s: str = "s", e: str = "e", gap: Column | float = 0.0, keep_empty: bool = False) -> DataFrame:
    """(keys..., island, s, e): the disjoint intervals of the union."""
    return islands(df, keys, s, e, gap, keep_empty).groupBy(*keys, "island").agg(F.min(s).alias("s"), F.max(e).alias("e"))


def union_length(df: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    return merged(df, keys, s, e).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("length"))


def steps(df: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """(keys..., t, next, active): elementary segments with the number of open intervals."""
    df = df.filter(F.col(e) > F.col(s))
    ends = df.select(*keys, F.col(s).alias("t"), F.lit(1).alias("d")).unionAll(df.select(*keys, F.col(e).alias("t"), F.lit(-1).alias("d")))
    at = ends.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("t")
    return at.select(*keys, "t", F.lead("t").over(order).alias("next"), F.sum("d").over(order).alias("active")).filter(F.col("next").isNotNull())


def k_active(df: DataFrame, keys: list[str], k: int, s: str = "s", e: str = "e") -> DataFrame:
    """Time with at least k intervals open."""
    length = F.when(F.col("active") >= k, F.col("next") - F.col("t")).otherwise(0.0)
    return steps(df, keys, s, e).groupBy(*keys).agg(F.sum(length).alias("length"))


def degree(df: DataFrame, keys: list[str], wall: Column | None = None, s: str = "s", e: str = "e") -> DataFrame:
    """Average number of open intervals over the wall (default: first start to last end) and over busy time,
    the largest, and the time with two or more."""
    span = F.col("next") - F.col("t")
    some = F.col("active") >= 1
    out = steps(df, keys, s, e).groupBy(*keys).agg(
        F.sum(span * F.col("active")).alias("work"), F.sum(F.when(some, span).otherwise(0.0)).alias("busy"),
        F.max("active").alias("max_degree"), F.sum(F.when(F.col("active") >= 2, span).otherwise(0.0)).alias("two_or_more"),
        (F.max("next") - F.min("t")).alias("span"),
    )
    return out.select(*keys, "work", "busy", "span", "max_degree", "two_or_more",
                      F.try_divide("work", wall if wall is not None else F.col("span")).alias("avg_over_wall"), F.try_divide("work", "busy").alias("avg_over_busy"))


def time_by_degree(df: DataFrame, keys: list[str], s: str = "s", e: str = "e") -> DataFrame:
    return steps(df, keys, s, e).groupBy(*keys, "active").agg(F.sum(F.col("next") - F.col("t")).alias("length"))


def both_active(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Time in which an interval of a and one of b are open."""
    def ends(df: DataFrame, x: int) -> DataFrame:
        df = df.filter("e > s")
        zero, one = F.lit(0), F.lit(1)
        cols = lambda d: (d if x == 0 else zero, d if x == 1 else zero)
        up, down = cols(one), cols(-one)
        return df.select(*keys, F.col("s").alias("t"), up[0].alias("da"), up[1].alias("db")).unionAll(df.select(*keys, F.col("e").alias("t"), down[0].alias("da"), down[1].alias("db")))

    at = ends(a, 0).unionAll(ends(b, 1)).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*keys).orderBy("t")
    seg = at.select(*keys, (F.lead("t").over(order) - F.col("t")).alias("len"), F.sum("da").over(order).alias("na"), F.sum("db").over(order).alias("nb"))
    return seg.groupBy(*keys).agg(F.coalesce(F.sum(F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("len"))), F.lit(0.0)).alias("length"))


def subtract(df: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., s, e) of df without the holes of the same keys (one interval of df for each keys)."""
    blocks = merged(holes, keys).withColumnsRenamed({"s": "hs", "e": "he"}).drop("island")
    inside = df.join(blocks, keys, "left").filter(F.col("hs").isNull() | ((F.col("he") > F.col("s")) & (F.col("hs") < F.col("e"))))
    order = Window.partitionBy(*keys, "s", "e").orderBy("hs")
    left = inside.select(*keys, "s", "e", F.greatest(F.lag("he").over(order), F.col("s")).alias("a"), "hs", "he", F.lead("hs").over(order).alias("nx"))
    before = left.select(*keys, F.coalesce("a", "s").alias("s"), F.least(F.coalesce("hs", "e"), F.col("e")).alias("e"))
    after = left.filter("nx is null and he is not null").select(*keys, F.greatest("he", "s").alias("s"), "e")
    none = df.join(inside.select(*keys).distinct(), keys, "left_anti").select(*keys, "s", "e")
    return before.unionAll(after).unionAll(none).filter("e > s")


def gaps(df: DataFrame, walls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., gap): idle stretches of each wall (keys..., ws, we) between the merged intervals."""
    blocks = merged(df, keys).drop("island")
    order = Window.partitionBy(*keys).orderBy("s")
    inner = blocks.join(walls, keys).select(*keys, (F.col("s") - F.coalesce(F.lag("e").over(order), F.col("ws"))).alias("gap"))
    last = walls.join(blocks.groupBy(*keys).agg(F.max("e").alias("e")), keys, "left").select(*keys, (F.col("we") - F.coalesce("e", "ws")).alias("gap"))
    return inner.unionAll(last).filter("gap > 0")


def peak(df: DataFrame, keys: list[str], s: str = "s", e: str = "e", least: float = 0.001) -> DataFrame:
    """Largest number of open intervals; ends come before starts at ties; every interval lasts at least ``least``."""
    end = F.greatest(F.col(e), F.col(s) + least)
    ends = df.select(*keys, F.col(s).alias("t"), F.lit(1).alias("d")).unionAll(df.select(*keys, end.alias("t"), F.lit(-1).alias("d")))
    order = Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return ends.select(*keys, F.sum("d").over(order).alias("n")).groupBy(*keys).agg(F.greatest(F.lit(1), F.max("n")).alias("peak"))


def covered(points: DataFrame, blocks: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """points with ``inside``: whether t lies in a block (disjoint, both ends included)."""
    tag = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_p"), F.lit(None).cast("double").alias("_e"))
    marks = blocks.select(*keys, F.col("s").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(tag.schema["_p"].dataType).alias("_p"), F.col("e").cast("double").alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return tag.unionByName(marks).withColumn("_last", F.last("_e", True).over(order)).filter("_k = 1").select("_p.*", F.coalesce(F.col("_t") <= F.col("_last"), F.lit(False)).alias("inside"))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], width: float, t: str = "t", s: str = "s", e: str = "e", how: str = "inner") -> DataFrame:
    """points x spans with s <= t <= e and equal keys, as an equi-join on bins of ``width``.

    A point falls into one bin, a span into all that it touches, so no pair comes twice.
    """
    left = points.withColumn("_bin", F.floor(F.col(t) / width))
    right = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    right = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns if c != "_bin"), F.col("_bin").alias("_rbin"))
    cond = (F.col("_bin") == F.col("_rbin")) & (F.col(t) >= F.col(s)) & (F.col(t) <= F.col(e))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop("_bin", "_rbin", *(f"_r_{k}" for k in keys))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of a (keys, as, ae, ...) and b (keys, bs, be, ...) that share time, as an equi-join on bins.

    A pair is kept only in the bin in which the later of the two starts, so none comes twice.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    left, right = a.withColumn("_bin", bins("as", "ae")), b.withColumn("_bin", bins("bs", "be"))
    both = left.join(right, [*keys, "_bin"]).filter((F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae")))
    return both.filter(F.floor(F.greatest("as", "bs") / width) == F.col("_bin")).drop("_bin")
