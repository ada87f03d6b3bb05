"""Packing by optimal length buckets.

The global histogram of lengths decides the bucket boundaries: dynamic programming
finds those with the least padding.  Inside each bucket, rows get consecutive ranks
and fill batches whose padded size stays within a token budget.  Ranks come from
counts per (bucket, block) and positions inside blocks, so no bucket meets in one task;
a block crowded by copies of one row is divided by the partitions that the copies came from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, small_side

#: Distinct lengths for which the dynamic programme tries every cut; with more it divides and
#: conquers.  Both find the same cuts.
MAX_LENGTHS = 6000
#: Rows of one block of ranks.
BLOCK_ROWS = 50_000
#: Times ``BLOCK_ROWS`` from which a block, one that holds a much repeated row, is divided.
CROWDED = 8


def word_count(text: str = "text") -> Column:
    """Whitespace-separated words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _every_cut(best: np.ndarray, value: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each last length but the first, the smallest best end of the buckets before."""
    out = np.zeros(len(value), np.int64)
    for j in range(1, len(value)):
        out[j] = (best[:j] - value[j] * rows[1 : j + 1] + tokens[1 : j + 1]).argmin()
    return out


def _divided(best: np.ndarray, value: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The same by divide and conquer, all ranges of one depth at once: the padding meets the
    quadrangle inequality, so the best ends ascend with the last length."""
    out = np.zeros(len(value), np.int64)
    first, last = np.array([1]), np.array([len(value) - 1])
    low, high = np.array([0]), np.array([len(value) - 2])
    while len(first):
        j = (first + last) // 2
        size = np.minimum(high, j - 1) - low + 1
        start = np.cumsum(size) - size
        k = np.arange(size.sum()) + np.repeat(low - start, size)
        cost = best[k] - np.repeat(value[j], size) * rows[k + 1] + tokens[k + 1]
        at = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, start), size))
        out[j] = k[at[np.searchsorted(at, start)]]
        first, last, low, high = (np.concatenate(x) for x in ((first, j + 1), (j - 1, last), (low, out[j]), (out[j], high)))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return out


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds with the least total padding.

    ``lengths`` ascend and are distinct.  Each bound is one of them and the last is
    the largest, so the result is optimal among all choices.
    """
    n = len(lengths)
    if not n:
        return []
    value = lengths.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    tokens = np.concatenate([[0], np.cumsum(value * counts)])
    cuts = _every_cut if n <= MAX_LENGTHS else _divided
    best = value * rows[1:] - tokens[1:]  # one bucket over lengths[: j + 1]
    choice = []
    for _ in range(1, min(buckets, n)):
        k = cuts(best, value, rows, tokens)
        cost = best[k] + value * (rows[1:] - rows[k + 1]) - (tokens[1:] - tokens[k + 1])
        less = cost < best
        less[0] = False
        choice.append(np.where(less, k + 1, 0))
        best = np.where(less, cost, best)
    out, j = [], n - 1
    for cut_at in [*reversed(choice), None]:
        out.append(int(lengths[j]))
        if cut_at is None:
            break
        if cut_at[j]:
            j = int(cut_at[j]) - 1
        else:  # fewer buckets do as well: the same prefix, one table down
            out.pop()
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, length: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket_len, batch_id, slot, batch_rows, padding.

    A batch of a bucket holds floor(``token_budget`` / bucket_len) rows (at least
    one, so a longer document is a batch of its own).  Only the last batch of a
    bucket may be short.  Null and empty texts have 0 tokens; null ids keep their
    rows; repeated rows get slots of their own.  An empty table gives no rows.
    """
    lengths = cut(docs.select(F.col(doc_id).alias("doc_id"), (length if length is not None else word_count(text)).alias("n_tokens"), F.xxhash64(text).alias("_h"), F.spark_partition_id().alias("_p")), "lengths")
    histogram = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    sizes, counts = (histogram.column(c).to_numpy() for c in ("n_tokens", "n"))
    bounds = boundaries(sizes, counts, buckets)
    if not bounds:
        bounds = [0]
    blocks = max(16, -(-int(counts.sum()) // BLOCK_ROWS))
    placed = lengths.withColumns({
        "bucket_len": F.element_at(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b >= F.col("n_tokens")), 1),
        "_block": F.pmod(F.xxhash64("doc_id", "_h"), F.lit(blocks)).cast("int"),
    })
    block, part = ["bucket_len", "_block"], ["bucket_len", "_block", "_sub"]
    crowded = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWDED * BLOCK_ROWS).select(*block, F.lit(True).alias("_many"))
    placed = placed.join(small_side(crowded, 16), block, "left").withColumn("_sub", F.when(F.col("_many"), F.col("_p")).otherwise(-1))
    in_block = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    per_bucket = Window.partitionBy("bucket_len").orderBy("_block", "_sub")
    offsets = in_block.select(*part, (F.sum("_n").over(per_bucket) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("bucket_len")).alias("_all"))
    inside = Window.partitionBy(*part).orderBy("doc_id", "_h")
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    ranked = (
        placed.withColumn("_at", F.row_number().over(inside).cast("long"))
        .join(small_side(offsets, 44), part)
        .withColumns({"_rank": F.col("_before") + F.col("_at") - 1, "_room": room})
    )
    batch = F.floor(F.col("_rank") / F.col("_room")).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket_len",
        F.concat_ws("-", F.col("bucket_len").cast("string"), batch.cast("string")).alias("batch_id"),
        (F.col("_rank") % F.col("_room")).alias("slot"),
        F.least(F.col("_room"), F.col("_all") - batch * F.col("_room")).alias("batch_rows"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
