"""Replay comparison: arms, configurations, warming, baselines, result index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from .metrics import q6

#: Names of runs (workflow, anything, stamp).
RUN_STAMP = r"^[A-Za-z0-9]+_.*?(\d{8}_\d{6})$"
CONFIG_ORDER = ["block_size", "kv_cache_dtype", "enable_prefix_caching"]


def arm_rollup(reps: DataFrame) -> DataFrame:
    """One row per arm: medians over its repetitions, attributes of the first, hit rates in order.

    Repetitions sort as text (rep10 before rep2)."""
    med = lambda c: q6(F.percentile(c, F.lit(0.5))).alias(c)
    return reps.groupBy("arm").agg(
        F.count(F.lit(1)).alias("reps"), med("ttft_ms"), med("tpot_ms"), med("total_ms"), F.min_by("config", "rep").alias("config"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rep", "hit_rate"))), lambda x: F.format_string("%.4f", x["hit_rate"])), ",").alias("hit_rates"),
    )


def source_case(source: Column, bundle: Column) -> tuple[Column, Column]:
    """(case, stamp) of the cell that a bundle was made of: the two folders below the path's last
    ``results`` name run and cell.  Without them the bundle's file name is the case, the stamp is empty."""
    below = r"^(?:.*/)?results/([^/]+)/([^/]+)"
    run, cell = (F.coalesce(F.regexp_extract(source, below, i), F.lit("")) for i in (1, 2))
    stamp = F.regexp_extract(run, RUN_STAMP, 1)
    at = F.when(stamp == "", "").otherwise(F.concat_ws(" ", F.concat_ws("-", F.substr(stamp, F.lit(5), F.lit(2)), F.substr(stamp, F.lit(7), F.lit(2))), F.concat_ws(":", F.substr(stamp, F.lit(10), F.lit(2)), F.substr(stamp, F.lit(12), F.lit(2)))))
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(bundle, F.lit("")), r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.when(cell == "", F.when(stem == "", "unknown source").otherwise(stem)).otherwise(F.concat(cell, F.lit(" \u00b7 "), at)), stamp


def sweep_arms(reps: DataFrame) -> DataFrame:
    """One row per arm of each sweep, from its repetitions (sweep, arm, rep, source, bundle, cache_state,
    recorded, hit_rate, ttft_ms, tpot_ms, total_ms): source case, cache states and medians.

    Newest case stamp first, then ``position`` (by time of recording): the order of the result index.
    Attributes are those of the first repetition as text; nulls are left out of medians and states.
    """
    med = lambda c: q6(F.percentile(c, F.lit(0.5))).alias(c)
    first = lambda c: F.min_by(c, "rep").alias(c)
    arms = reps.groupBy("sweep", "arm").agg(
        F.count(F.lit(1)).alias("reps"), first("source"), first("bundle"), F.coalesce(first("recorded"), F.lit(0)).cast("long").alias("recorded"),
        F.array_join(F.sort_array(F.collect_set("cache_state")), ",").alias("cache_states"), *map(med, ("hit_rate", "ttft_ms", "tpot_ms", "total_ms")),
    )
    case, stamp = source_case(F.col("source"), F.col("bundle"))
    order = Window.partitionBy("stamp").orderBy("recorded", "sweep", "arm")
    return arms.withColumns({"case": case, "stamp": stamp}).drop("source", "bundle").withColumn("position", F.row_number().over(order))


def comparability(reps: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that take more than one value over all arms."""
    long = reps.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_distinct("value").alias("n")).filter("n > 1")


def differing_config(arms: DataFrame) -> DataFrame:
    """Keys of the arms' config (JSON text) with more than one value; an absent key is a value of its own."""
    kv = arms.select("arm", F.explode(F.from_json("config", "map<string,string>")).alias("key", "value"))
    arms_in_all = arms.select("arm").distinct().count()
    absent = F.when(F.count_distinct("arm") < arms_in_all, 1).otherwise(0)
    n = kv.groupBy("key").agg((F.count_distinct("value") + absent).alias("n")).filter("n > 1")
    place = F.array_position(F.array(*map(F.lit, CONFIG_ORDER)), F.col("key"))
    return n.select("key", "n", F.when(place > 0, place).otherwise(len(CONFIG_ORDER) + 1).cast("int").alias("place"))


def warming_arms(reps: DataFrame, spread: float = 0.05) -> DataFrame:
    """Arms whose hit rates move more than ``spread``: no replicates of each other."""
    return reps.groupBy("arm").agg(F.min("hit_rate").alias("lo"), F.max("hit_rate").alias("hi")).filter(F.col("hi") - F.col("lo") > spread)


def against_baseline(arms: DataFrame) -> DataFrame:
    """Each arm's medians relative to the first recorded arm of its bundle, in per cent."""
    order = Window.partitionBy("bundle").orderBy("recorded", "arm").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pct = lambda c: q6(100 * F.try_divide(F.col(c) - F.first(c).over(order), F.first(c).over(order))).alias(f"{c}_pct")
    return arms.select("bundle", "arm", pct("ttft_ms"), pct("tpot_ms"), pct("total_ms"))


def replay_summary(requests: DataFrame) -> DataFrame:
    """Wall, tokens, medians and peak concurrency of each replay."""
    base = requests.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input").alias("prompt_tokens"), F.sum("output").alias("output_tokens"), q6((F.max("e") - F.min("s")) / 1000).alias("wall_s"),
        q6(F.percentile(F.col("first_token") - F.col("s"), F.lit(0.5))).alias("ttft_p50"), q6(F.percentile(F.col("e") - F.col("s"), F.lit(0.5))).alias("total_p50"),
    )
    return base.join(I.peak(requests, ["run_id"]), "run_id").withColumn("peak", F.col("peak").cast("long"))


def cache_state(queries: str = "queries", hits: str = "hits", reset: str = "reset"):
    """cold_by_reset, cold_since_restart (no query yet) or warm_inherited."""
    return F.when(F.col(reset), "cold_by_reset").when((F.col(queries) == 0) & (F.col(hits) == 0), "cold_since_restart").otherwise("warm_inherited")


def prefix_cache_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Hit rate between two readings; null if nothing was asked or a counter went back."""
    b = before.select(*keys, F.col("queries").alias("q0"), F.col("hits").alias("h0"))
    d = after.join(b, keys).select(*keys, (F.col("queries") - F.col("q0")).alias("queries"), (F.col("hits") - F.col("h0")).alias("hits"))
    ok = (F.col("queries") > 0) & (F.col("hits") >= 0)
    return d.select(*keys, "queries", "hits", q6(F.when(ok, F.try_divide("hits", "queries"))).alias("hit_rate"))


def ready_tasks(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks not done whose dependencies all are."""
    unmet = deps.join(done.select(F.col("task").alias("needs")), "needs", "left_anti").select("task").distinct()
    return tasks.join(done.select("task"), "task", "left_anti").join(unmet, "task", "left_anti")


def first_n(df: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The first n rows of each key in sorted order; a key with fewer fails."""
    w = Window.partitionBy(key)
    short = F.when(F.count(F.lit(1)).over(w) < n, F.raise_error(F.concat(F.lit("too few rows for "), F.col(key).cast("string"))).cast("int"))
    return df.withColumn("_i", F.coalesce(short, F.row_number().over(w.orderBy(by)))).filter(F.col("_i") <= n).drop("_i")


def workflow_groups(rows: DataFrame, workflows: DataFrame) -> DataFrame:
    """Result rows counted by workflow, workflows without rows included."""
    n = rows.groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), F.max("recorded").alias("last"))
    return workflows.join(n, "workflow", "left").select("workflow", F.coalesce("n", F.lit(0)).alias("n"), "last")
