"""Time and concurrency of runs: who was active, in parallel with what, for how long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from .metrics import RUN, q6


def concurrency_summary(llm: DataFrame, tools: DataFrame) -> DataFrame:
    """Wall, inference, tool and residual time, overlap and degree of each run (seconds)."""
    llm, tools = llm.select("run_id", "s", "e"), tools.select("run_id", "s", "e")
    both = llm.unionAll(tools)
    wall = both.groupBy("run_id").agg(((F.max("e") - F.min("s")) / 1000).alias("wall_s"))
    lengths = lambda df, name: I.union_length(df, RUN).select("run_id", (F.col("length") / 1000).alias(name))
    over = I.both_active(llm, tools, RUN).select("run_id", (F.col("length") / 1000).alias("overlap_s"))
    deg = I.degree(both, RUN).select("run_id", F.col("max_degree"), "avg_over_busy", (F.col("two_or_more") / 1000).alias("two_s"), (F.col("busy") / 1000).alias("busy_s"))
    out = wall.join(lengths(llm, "llm_s"), "run_id", "left").join(lengths(tools, "tool_s"), "run_id", "left").join(over, "run_id", "left").join(deg, "run_id", "left").na.fill(0.0, ["llm_s", "tool_s", "overlap_s"])
    return out.select("run_id", *(q6(F.col(c)).alias(c) for c in ("wall_s", "llm_s", "tool_s", "overlap_s", "two_s")), q6(F.col("wall_s") - F.col("busy_s")).alias("residual_s"), "max_degree", q6(F.col("avg_over_busy")).alias("avg_degree"))


def self_time(tools: DataFrame, llm: DataFrame, width_ms: float = 3_600_000.0) -> DataFrame:
    """Each tool call's time without the inference inside it (seconds, not rounded); 0 where inference fills it."""
    own = tools.select("run_id", "tool_id", "s", "e")
    calls = llm.select("run_id", F.col("s").alias("bs"), F.col("e").alias("be")).filter("be > bs")
    inside = I.overlap_join(own.select("run_id", "tool_id", F.col("s").alias("as"), F.col("e").alias("ae")), calls, ["run_id"], width_ms)
    holes = inside.select("run_id", "tool_id", F.greatest("as", "bs").alias("s"), F.least("ae", "be").alias("e"))
    rest = own.join(I.union_length(holes, ["run_id", "tool_id"]), ["run_id", "tool_id"], "left")
    return rest.select("run_id", "tool_id", ((F.col("e") - F.col("s") - F.coalesce("length", F.lit(0.0))) / 1000).alias("self_s"))


def containment_parents(events: DataFrame, width_ms: float = 3_600_000.0) -> DataFrame:
    """events with ``parent``: the smallest tool of the same run and role that encloses the call."""
    tools = events.filter("kind = 'tool'").select("run_id", "role", F.col("id").alias("p_id"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    pairs = I.range_join(events.select("run_id", "role", "id", "s", "e"), tools, ["run_id", "role"], width_ms, "s", "ps", "pe").filter("e <= pe and id <> p_id and not (s = ps and e = pe and p_id > id)")
    best = pairs.groupBy("run_id", "id").agg(F.min_by("p_id", F.struct(F.col("pe") - F.col("ps"), F.col("p_id"))).alias("parent"))
    return events.join(best, ["run_id", "id"], "left")


def children(events: DataFrame) -> DataFrame:
    return events.filter("parent is not null").groupBy("run_id", "parent").agg(F.sort_array(F.collect_list("id")).alias("children"))


def sequence_edges(events: DataFrame) -> DataFrame:
    """(run_id, a, b): each sibling and the next by start, without parent-child pairs."""
    order = Window.partitionBy("run_id", F.coalesce("parent", F.lit(""))).orderBy("s", "e", "id")
    nxt = events.withColumn("b", F.lead("id").over(order)).filter("b is not null").select("run_id", F.col("id").alias("a"), "b")
    tree = events.filter("parent is not null").select("run_id", F.col("parent").alias("a"), F.col("id").alias("b"))
    return nxt.join(tree, ["run_id", "a", "b"], "left_anti")


def depths(events: DataFrame) -> DataFrame:
    """(run_id, id, depth), roots have depth 0: in each round every event jumps to the ancestor of its
    ancestor, so rounds grow with the logarithm of the depth.  Events without a path to a root
    (an unknown parent, a cycle) have no row.
    """
    spark = events.sparkSession
    kept = lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
    roots = events.filter("parent is null").select("run_id", "id", F.lit(0).alias("depth"))
    open_ = events.filter("parent is not null").select("run_id", "id", F.col("parent").alias("up"), F.lit(1).alias("hops"))
    done, left = kept(roots), None
    while True:
        top = done.select("run_id", F.col("id").alias("up"), "depth")
        reached = open_.join(top, ["run_id", "up"]).select("run_id", "id", (F.col("hops") + F.col("depth")).alias("depth"))
        higher = open_.select("run_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("more"))
        open_ = kept(open_.join(higher, ["run_id", "up"]).select("run_id", "id", F.col("up2").alias("up"), (F.col("hops") + F.col("more")).alias("hops")))
        done = kept(done.unionAll(reached))
        n, known = open_.count(), done.count()
        if not n or (n, known) == left:
            return done
        left = (n, known)


def max_leaf_width(events: DataFrame) -> DataFrame:
    """Largest number of events open at once of which no child is open: an event counts where it
    has no child, or outside its children's time."""
    kids = events.filter("parent is not null").select("run_id", F.col("parent").alias("id"), "s", "e")
    own = I.subtract(events.select("run_id", "id", "s", "e"), kids, ["run_id", "id"])
    return I.peak(own, RUN, least=0.0)


def pairwise_overlap(events: DataFrame, width_ms: float = 3_600_000.0) -> DataFrame:
    """Time in which calls of two kinds (or roles) are both open, by pair of roles."""
    ev = events.select("run_id", "role", "s", "e")
    merged = I.merged(ev, ["run_id", "role"]).select("run_id", F.col("role").alias("rb"), F.col("s").alias("bs"), F.col("e").alias("be"))
    own = I.merged(ev, ["run_id", "role"]).select("run_id", F.col("role").alias("ra"), F.col("s").alias("as"), F.col("e").alias("ae"))
    return I.overlap_join(own, merged, ["run_id"], width_ms).filter("ra < rb").groupBy("run_id", "ra", "rb").agg(q6(F.sum(I.overlap(*map(F.col, ("as", "ae", "bs", "be")))) / 1000).alias("overlap_s"))


def process_intervals(fs: DataFrame) -> DataFrame:
    """First to last event of each process."""
    return fs.groupBy("run_id", "pid").agg(F.min("ts_ms").alias("s"), F.max("ts_ms").alias("e"))


def busy_workers(fs: DataFrame, worker: str = "role") -> DataFrame:
    """Merged I/O time of each worker and how many workers do I/O at once."""
    ops = fs.select("run_id", F.col(worker).alias("worker"), (F.col("ts_ms") - F.greatest(F.lit(0.0), F.col("dur_s") * 1000)).alias("s"), F.col("ts_ms").alias("e"))
    blocks = I.merged(ops, ["run_id", "worker"])
    return I.degree(blocks, RUN).select("run_id", q6(F.col("work") / 1000).alias("worker_s"), q6(F.col("busy") / 1000).alias("busy_s"), "max_degree", q6(F.col("avg_over_busy")).alias("avg_workers"))


def llm_usage(llm: DataFrame) -> DataFrame:
    """Calls, tokens and cached tokens by role and phase, with subtotals (``level``)."""
    return llm.rollup("run_id", "role", "phase").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read")).filter("level < 7")


def usage_by_parent(calls: DataFrame) -> DataFrame:
    """Calls and tokens below each parent (``parent``); calls without one form a row of their own."""
    tokens = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_read"))
    return calls.groupBy("run_id", F.coalesce("parent", F.lit("(root)")).alias("owner")).agg(F.count(F.lit(1)).alias("calls"), *tokens)


def token_residual(calls: DataFrame) -> DataFrame:
    """How far ``counted`` tokens stay behind what the server recorded (``recorded``), per run.

    Calls that were not counted (null) are left out of both sums; without recorded tokens there is
    no percentage.  A null record counts as 0 and is never exact.
    """
    done, recorded = F.col("counted").isNotNull(), F.coalesce("recorded", F.lit(0))
    sums = calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(done).alias("n_tokenized"), F.count_if(done & (recorded > 0) & (F.col("counted") == recorded)).alias("n_exact"),
        F.sum("counted").alias("counted"), F.sum(F.when(done, recorded)).alias("recorded"),
    )
    share = F.when(F.col("recorded") > 0, q6(100 * (1 - F.col("counted") / F.col("recorded"))))
    return sums.select("run_id", "calls", "n_tokenized", "n_exact", share.alias("residual_pct"))


def run_summary(llm: DataFrame, tools: DataFrame) -> DataFrame:
    """Wall, tool, inference and unaccounted seconds of a run, with its token totals."""
    base = concurrency_summary(llm, tools)
    tokens = llm.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"))
    return base.join(tokens, "run_id", "left").select("run_id", "wall_s", "llm_s", "tool_s", F.col("residual_s").alias("unaccounted_s"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("input", F.lit(0)).alias("input"), F.coalesce("output", F.lit(0)).alias("output"))


def subagent_metrics(events: DataFrame) -> DataFrame:
    """Calls and seconds below each parent; calls without one form a row of their own."""
    own = events.withColumn("owner", F.coalesce("parent", F.lit("(root)")))
    return own.groupBy("run_id", "owner").agg(F.count_if(F.col("kind") == "llm").alias("llm_calls"), F.count_if(F.col("kind") == "tool").alias("tool_calls"), q6(F.sum(F.col("e") - F.col("s")) / 1000).alias("seconds"))


def unit_io(fs: DataFrame, unit: str = "pid") -> DataFrame:
    """I/O of each execution unit with its share of the run, and the run's skew."""
    ops = fs.withColumn("unit", F.col(unit)).filter(F.col("bytes_transferred") > 0)
    ops = ops.withColumns({"s": F.col("ts_ms") - F.col("dur_s") * 1000, "e": F.col("ts_ms")})
    by = ops.groupBy("run_id", "unit").agg(F.count(F.lit(1)).alias("ops"), F.sum("bytes_transferred").alias("bytes"))
    busy = I.union_length(ops, ["run_id", "unit"])
    total = Window.partitionBy("run_id")
    return by.join(busy, ["run_id", "unit"], "left").select("run_id", "unit", "ops", "bytes", q6(F.coalesce("length", F.lit(0.0)) / 1000).alias("busy_s"), q6(F.col("bytes") / F.sum("bytes").over(total)).alias("share"))


def unit_skew(fs: DataFrame, unit: str = "pid") -> DataFrame:
    by = fs.filter(F.col("bytes_transferred") > 0).groupBy("run_id", F.col(unit).alias("unit")).agg(F.sum("bytes_transferred").alias("b"))
    return by.groupBy("run_id").agg(F.count(F.lit(1)).alias("units"), q6(F.max("b") / F.percentile("b", F.lit(0.5))).alias("max_over_median"), q6(F.percentile("b", F.lit(0.95)) / F.percentile("b", F.lit(0.5))).alias("p95_over_p50"))


def tool_rows(tools: DataFrame) -> DataFrame:
    """Rows of a time chart: calls, first start, last end and seconds of each tool."""
    return tools.groupBy("run_id", "tool_name").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"), q6(F.sum(F.col("e") - F.col("s")) / 1000).alias("seconds"))


def pixel_rows(tools: DataFrame, pixels: int = 2000) -> DataFrame:
    """Chart rows quantised to pixels of the run's span."""
    w = Window.partitionBy("run_id")
    span = F.max("e").over(w) - F.min("s").over(w)
    px = F.floor((F.col("s") - F.min("s").over(w)) * pixels / span)
    return tools.select("run_id", "tool_name", px.cast("long").alias("px")).groupBy("run_id", "tool_name", "px").agg(F.count(F.lit(1)).alias("n"))


def io_fill(by_tool: DataFrame) -> DataFrame:
    """Shade of a node: log10 of its bytes up to 1e6, else of its metadata calls up to 1e3."""
    b = F.col("read_bytes") + F.col("write_bytes")
    shade = F.when(b > 0, F.least(F.lit(1.0), F.log10(b + 1.0) / 6)).otherwise(F.least(F.lit(1.0), F.log10(F.col("meta") + 1.0) / 3))
    return by_tool.select("run_id", "tool_call", q6(shade).alias("fill"))


def token_rate(llm: DataFrame, bin_s: float = 5.0) -> DataFrame:
    """Output tokens spread evenly over each call, by bin of the run's time."""
    t0 = F.min("s").over(Window.partitionBy("run_id"))
    x = llm.select("run_id", ((F.col("s") - t0) / 1000).alias("a"), ((F.col("e") - t0) / 1000).alias("z"), "output").filter("z > a")
    x = x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / bin_s), F.floor(F.col("z") / bin_s))))
    part = F.greatest(F.lit(0.0), F.least(F.col("z"), (F.col("bin") + 1) * bin_s) - F.greatest(F.col("a"), F.col("bin") * bin_s))
    return x.groupBy("run_id", "bin").agg(q6(F.sum(F.col("output") / (F.col("z") - F.col("a")) * part)).alias("tokens"))


def latency_stats(llm: DataFrame) -> DataFrame:
    """First-token and per-token latency by role, phase and over all (``level``)."""
    x = llm.withColumns({"ttft": F.col("first_token") - F.col("s"), "total": F.col("e") - F.col("s"), "tpot": F.try_divide(F.col("e") - F.col("first_token"), F.nullif(F.col("output") - 1, F.lit(0)))})
    return x.rollup("run_id", "role", "phase").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), q6(F.percentile("ttft", F.lit(0.5))).alias("ttft_p50"), q6(F.percentile("ttft", F.lit(0.95))).alias("ttft_p95"), q6(F.percentile("tpot", F.lit(0.5))).alias("tpot_p50"),
                                                   q6(F.try_divide(1000 * F.sum("output"), F.sum("total"))).alias("tokens_per_s")).filter("level < 7")


def slowest_calls(llm: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc(F.col("e") - F.col("s")), "call")
    return llm.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("run_id", "rank", "call", (F.col("e") - F.col("s")).alias("ms"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] = RUN) -> DataFrame:
    """Rank correlation with averaged ties; null without variance."""
    def rank(c: str):
        w = Window.partitionBy(*keys).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, rank(x).alias("rx"), rank(y).alias("ry"))
    var = F.var_pop("rx") * F.var_pop("ry")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q6(F.try_divide(F.covar_pop("rx", "ry"), F.sqrt(F.nullif(var, F.lit(0.0))))).alias("rho"))
