"""Prefix reuse of prompts: logical matches, candidates, segments, cache blocks, demand.

A prompt is an array of tokens.  The trie over all prompts of a run is a relation:
one row per call and depth with a hash of the prefix of that depth, computed in one
pass over each prompt.  Matches, candidates and segments are equi-joins and
aggregates on (depth, hash).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import RUN, q6

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Rows of one batch of prefixes.
ROWS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def whitespace_tokens(text: Column) -> Column:
    """The default tokenizer: words between white space."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def trie(calls: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(run_id, call, depth, hash): a row for each prefix of each prompt.

    Prefix hashes are running sums of token hashes times powers of an odd base, so a
    prompt of n tokens costs n steps.
    """
    hashed = calls.select("run_id", "call", F.transform(tokens, lambda t: F.xxhash64(t)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            if not len(row):
                continue
            start = np.repeat(np.cumsum(sizes) - sizes, sizes)
            x = _mix(b.column(2).flatten().to_numpy(zero_copy_only=False).view(_U))
            depth = np.arange(len(row)) - start
            power = np.multiply.accumulate(np.full(int(sizes.max()), _BASE, _U))
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(x * power[depth], dtype=_U)])
            prefix = _mix(sums[1:] - sums[start]).view(np.int64)
            for lo in range(0, len(row), ROWS):
                part = slice(lo, lo + ROWS)
                at = pa.array(row[part])
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array((depth[part] + 1).astype(np.int32)), pa.array(prefix[part])], names=["run_id", "call", "depth", "hash"])

    kinds = {c: calls.schema[c].dataType.simpleString() for c in ("run_id", "call")}
    return hashed.mapInArrow(run, f"run_id {kinds['run_id']}, call {kinds['call']}, depth int, hash long")


def logical_reuse(nodes: DataFrame, calls: DataFrame, scope: list[str] = []) -> DataFrame:
    """(run_id, call, matched): longest prefix of each prompt that an earlier call of the run
    (and of the same ``scope`` columns) sent."""
    nodes = nodes.join(calls.select("run_id", "call", *scope), ["run_id", "call"]) if scope else nodes
    first = nodes.groupBy("run_id", *scope, "depth", "hash").agg(F.min("call").alias("first"))
    hit = nodes.join(first, ["run_id", *scope, "depth", "hash"]).filter("first < call").groupBy("run_id", "call").agg(F.max("depth").alias("matched"))
    return calls.select("run_id", "call", "n_tokens").join(hit, ["run_id", "call"], "left").select("run_id", "call", "n_tokens", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def reuse_by_run(matches: DataFrame) -> DataFrame:
    return matches.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("n_tokens").alias("tokens"), F.sum("matched").alias("reused"), q6(F.try_divide(F.sum("matched"), F.sum("n_tokens"))).alias("share"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(run_id, call, source, lcp): the earlier calls that share the longest prefix with a call.

    They all sit at one trie node, the deepest that an earlier call reached, so calls
    are joined there and at no other depth.
    """
    first = nodes.groupBy("run_id", "depth", "hash").agg(F.min("call").alias("first"))
    deepest = nodes.join(first, ["run_id", "depth", "hash"]).filter("first < call").groupBy("run_id", "call").agg(F.max(F.struct("depth", "hash")).alias("at"))
    here = deepest.select("run_id", "call", F.col("at.depth").alias("depth"), F.col("at.hash").alias("hash"))
    source = nodes.select("run_id", "depth", "hash", F.col("call").alias("source"))
    return here.join(source, ["run_id", "depth", "hash"]).filter("source < call").select("run_id", "call", "source", F.col("depth").alias("lcp"))


def candidate_counts(cand: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls by number of candidates: 0, 1, 2, 3 or more."""
    n = cand.groupBy("run_id", "call").agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.coalesce("n", F.lit(0)), F.lit(3)).cast("int")
    return calls.select("run_id", "call").join(n, ["run_id", "call"], "left").groupBy("run_id", k.alias("candidates")).agg(F.count(F.lit(1)).alias("calls"))


def lineage_parents(cand: DataFrame, unit: int = 1) -> DataFrame:
    """The latest candidate of each call, if at least one aligned unit of its prefix is shared."""
    return cand.filter(F.floor(F.col("lcp") / unit) > 0).groupBy("run_id", "call").agg(F.max("source").alias("parent"), F.max("lcp").cast("long").alias("lcp"))


#: Age bins in seconds.
AGE_BINS = [(5, "<5s"), (15, "5–15s"), (30, "15–30s"), (60, "30–60s"), (None, ">60s")]


def age_bin(seconds: Column) -> Column:
    out = F
    for hi, label in AGE_BINS[:-1]:
        out = out.when(seconds < hi, label)
    return out.otherwise(AGE_BINS[-1][1])


def source_age(cand: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, call, age, lcp): seconds since the latest candidate ended before the call; calls without one have no row."""
    done = calls.select("run_id", F.col("call").alias("source"), F.col("e").alias("ended"))
    x = cand.join(done, ["run_id", "source"]).join(calls.select("run_id", "call", "s"), ["run_id", "call"]).filter("ended <= s")
    return x.groupBy("run_id", "call").agg(F.min((F.col("s") - F.col("ended")) / 1000).alias("age"), F.max("lcp").alias("lcp"))


def reuse_ages(cand: DataFrame, calls: DataFrame, high: float = 0.7) -> DataFrame:
    """Per run: the oldest source of a call with just one candidate, and the median source age of calls
    that realised more than ``high`` of their prompt (seconds; null where no call is of that kind)."""
    n = cand.groupBy("run_id", "call").agg(F.count(F.lit(1)).alias("n"))
    aged = source_age(cand, calls).join(n, ["run_id", "call"]).select("run_id", "call", "age", "n")
    x = calls.select("run_id", "call", "input", "cache_read").join(aged, ["run_id", "call"], "left")
    realised = (F.col("input") > 0) & (F.col("cache_read") / F.col("input") > high)
    return x.groupBy("run_id").agg(
        F.count("age").alias("reusable_calls"), q6(F.max(F.when(F.col("n") == 1, F.col("age")))).alias("longest_unique_s"),
        q6(F.percentile(F.when(realised, F.col("age")), F.lit(0.5))).alias("median_high_reuse_s"),
    )


def temporal_reuse(cand: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls and shared tokens by age of the latest candidate that had ended, empty bins as zeros."""
    last = source_age(cand, calls)
    found = last.groupBy("run_id", age_bin(F.col("age")).alias("bin")).agg(F.count(F.lit(1)).alias("calls"), F.sum("lcp").alias("tokens"))
    grid = calls.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(b) for _, b in AGE_BINS))).alias("bin"))
    return grid.join(found, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def source_class(repeats: Column, candidates: Column) -> Column:
    """An exact repeat comes first, then the number of candidates."""
    return F.when(repeats > 0, "exact repeat").when(candidates == 0, "no candidate").when(candidates == 1, "unique").when(candidates == 2, "2 sources").otherwise("3+ sources")


def reuse_band(cached: Column, sent: Column, logical: Column, high: float = 0.7) -> Column:
    """Realised share above 70 per cent, above 0, or 0 where a logical match existed; else null."""
    share = F.try_divide(cached, sent)
    return F.when(sent <= 0, None).when(share > high, "realized >70%").when(share > 0, "realized 1–70%").when(logical > 0, "realized 0%, logical >0")


def source_classes(cand: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls by source class and reuse band."""
    earlier = F.row_number().over(Window.partitionBy("run_id", "cache_key").orderBy("call")) - 1
    found = cand.groupBy("run_id", "call").agg(F.count(F.lit(1)).alias("n"), F.max("lcp").alias("lcp"))
    x = calls.select("run_id", "call", "input", "cache_read", earlier.alias("repeats")).join(found, ["run_id", "call"], "left")
    kind = source_class(F.col("repeats"), F.coalesce("n", F.lit(0)))
    return x.groupBy("run_id", kind.alias("kind"), reuse_band(F.col("cache_read"), F.col("input"), F.coalesce("lcp", F.lit(0))).alias("band")).agg(F.count(F.lit(1)).alias("calls"))


def segments(nodes: DataFrame) -> DataFrame:
    """Maximal token runs with the same set of calls: all trie nodes with one call set form one chain."""
    node = nodes.groupBy("run_id", "depth", "hash").agg(F.sort_array(F.collect_set("call")).alias("calls"))
    seg = node.groupBy("run_id", "calls").agg(F.count(F.lit(1)).alias("tokens"), F.min("depth").alias("from_depth"))
    return seg.select("run_id", F.array_join(F.transform("calls", lambda c: c.cast("string")), ",").alias("calls"), F.size("calls").cast("long").alias("n_calls"), "tokens", (F.col("from_depth") - 1).cast("long").alias("offset"), (F.col("tokens") * (F.size("calls") - 1)).alias("reused"))


def realized(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Tokens of each segment that servers reported as cached: a call's cut is its cache_read scaled
    to our tokens; the creator is never credited."""
    node = nodes.groupBy("run_id", "depth", "hash").agg(F.sort_array(F.collect_set("call")).alias("calls"))
    seg = node.groupBy("run_id", "calls").agg(F.count(F.lit(1)).alias("tokens"), (F.min("depth") - 1).alias("start"))
    users = seg.select("run_id", "calls", "tokens", "start", F.explode(F.slice("calls", 2, F.greatest(F.size("calls") - 1, F.lit(0)))).alias("call"))
    cut = calls.select("run_id", "call", F.try_divide(F.col("cache_read") * F.col("n_tokens"), "input").alias("cut"))
    covered = F.greatest(F.lit(0.0), F.least(F.col("cut") - F.col("start"), F.col("tokens"))).cast("long")
    return users.join(cut, ["run_id", "call"]).groupBy("run_id").agg(F.sum(covered).alias("realized"), F.sum("tokens").alias("logical")).withColumn("gap", F.col("logical") - F.col("realized"))


def aligned(tokens: Column, reported: Column, ours: Column, unit: int) -> Column:
    """Tokens in the provider's count, rounded down to whole cache units."""
    return (F.floor(F.try_divide(tokens * reported, ours) / unit) * unit).cast("long")


def cache_unit(override: Column, observed: Column, server: Column, default: int = 128) -> Column:
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(override), positive(observed), positive(server), F.lit(default))


def block_references(calls: DataFrame, block: int, tokens: str = "tokens") -> DataFrame:
    """(run_id, call, position, block_id): complete blocks of each prompt; an id is the SHA-256 of the
    parent's digest, a colon and the block as JSON."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for r, c, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                parent = b""
                for p in range(len(t or []) // block):
                    digest = hashlib.sha256(parent + b":" + json.dumps(t[p * block : (p + 1) * block], separators=(",", ":")).encode())
                    parent = digest.digest()
                    for x, v in zip(out, (r, c, p, digest.hexdigest()), strict=True):
                        x.append(v)
            yield pa.record_batch([pa.array(out[0], b.column(0).type), pa.array(out[1], b.column(1).type), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["run_id", "call", "position", "block_id"])

    kinds = {c: calls.schema[c].dataType.simpleString() for c in ("run_id", "call")}
    return calls.select("run_id", "call", tokens).mapInArrow(run, f"run_id {kinds['run_id']}, call {kinds['call']}, position int, block_id string")


def _not_above_before(x: np.ndarray) -> np.ndarray:
    """For each entry, how many earlier ones are not larger; halves of doubling blocks are compared by sorting."""
    at, out, span = np.arange(len(x)), np.zeros(len(x), np.int64), int(x.max(initial=0)) + 1
    half = 1
    while half < len(x):
        code, late = at // (2 * half) * span, at // half % 2 == 1
        early = np.sort((code + x)[~late])
        out[late] += np.searchsorted(early, (code + x)[late], "right") - np.searchsorted(early, code[late])
        half *= 2
    return out


def stack_distances(keys: list) -> np.ndarray:
    """LRU stack distance of each reference: distinct other keys since its last use; -1 where there is none.

    A reference since then counts where its own key came no later than ours did, as it is the
    first of its key; all references up to that point meet this too and are taken off.
    """
    which = np.unique(np.array(keys, dtype=object).astype(str), return_inverse=True)[1].reshape(-1) if len(keys) else np.zeros(0, np.int64)
    order = np.argsort(which, kind="stable")
    previous = np.zeros(len(which), np.int64)  # places count from 1, so 0 is no use before
    again = np.flatnonzero(which[order][1:] == which[order][:-1]) + 1
    previous[order[again]] = order[again - 1] + 1
    return np.where(previous > 0, _not_above_before(previous) - previous, -1)


def lru_distances(refs: DataFrame) -> DataFrame:
    """(run_id, distance, n) of the references (run_id, call, position, block_id); distance null: cold.
    A run's references are one ordered group."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("call", "ascending"), ("position", "ascending")])
        values, n = np.unique(stack_distances(t.column("block_id").to_pylist()), return_counts=True)
        return pa.table({"run_id": pa.array([t.column("run_id")[0].as_py()] * len(values), t.schema.field("run_id").type), "distance": pa.array([None if v < 0 else int(v) for v in values], pa.int64()), "n": n})

    return refs.groupBy("run_id").applyInArrow(run, f"run_id {refs.schema['run_id'].dataType.simpleString()}, distance long, n long")


# ---- demand ------------------------------------------------------------------------------------


def length_stats(calls: DataFrame, x: str = "input") -> DataFrame:
    """n, sum, min, median, mean, nearest-rank p90 (half-even) and max of the prompt lengths."""
    w = Window.partitionBy("run_id")
    r = calls.select("run_id", F.col(x).alias("x"), F.row_number().over(w.orderBy(x)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = F.bround(0.9 * (F.col("n") - 1), 0).cast("int") + 1
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), q6(F.percentile("x", F.lit(0.5))).alias("median"), q6(F.avg("x")).alias("mean"), F.max(F.when(F.col("i") == at, F.col("x"))).alias("p90"), F.max("x").alias("most"))


def context_growth(calls: DataFrame) -> DataFrame:
    """Slope of prompt length over the calls of each role (0 if degenerate)."""
    i = F.row_number().over(Window.partitionBy("run_id", "role").orderBy("call")) - 1
    return calls.select("run_id", "role", i.cast("double").alias("i"), F.col("input").cast("double").alias("y")).groupBy("run_id", "role").agg(F.count(F.lit(1)).alias("n"), q6(F.coalesce(F.regr_slope("y", "i"), F.lit(0.0))).alias("slope"))


def verbatim_resubmission(calls: DataFrame) -> DataFrame:
    """Prompts sent again unchanged and the tokens of their first submission."""
    by = calls.groupBy("run_id", "cache_key").agg(F.count(F.lit(1)).alias("n"), F.min_by("input", "call").alias("input"))
    again = by.groupBy("run_id").agg(F.sum(F.col("n") - 1).alias("repeats"), F.sum((F.col("n") - 1) * F.col("input")).alias("tokens"))
    total = calls.groupBy("run_id").agg(F.sum("input").alias("all_tokens"))
    return again.join(total, RUN).select("run_id", "repeats", "tokens", q6(F.try_divide("tokens", "all_tokens")).alias("share"))


def provenance(calls: DataFrame) -> DataFrame:
    """Where a run's cached-token numbers come from; unmeasured is not zero."""
    seen = F.col("cache_read").isNotNull()
    src = F.when(F.bool_and(seen), "response").when(F.bool_or(seen), "partial").otherwise("unmeasured")
    return calls.groupBy("run_id").agg(src.alias("source"), F.when(F.bool_or(seen), F.sum("cache_read")).alias("cached"), F.sum("input").alias("input"))


def collapse_emissions(calls: DataFrame, window_ms: float = 100.0) -> DataFrame:
    """calls without those equal in key, input and output to the last kept one within ``window_ms``;
    an ordered fold over the calls of one key."""
    schema = calls.schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("e", "ascending"), ("call", "ascending")])
        keep, last = [], None
        for i, e in enumerate(t.column("e").to_pylist()):
            if last is None or e - last > window_ms:
                keep.append(i)
                last = e
        return t.take(pa.array(keep, pa.int64()))

    return calls.groupBy("run_id", "cache_key", "input", "output").applyInArrow(run, schema)
