"""Line deduplication across documents.

Lines are exploded with their positions, their keys (trimmed, A-Z lower-cased)
hashed, documents per key counted after one row per document and key, and the
flags of the lines travel back by position.  Only hashes and positions cross the
network for counting; each text moves once, next to its flags.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches, widened

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: Keys with over 1/HEAVY of all lines are joined by broadcast: at most HEAVY of them exist.
HEAVY = 2000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None if the key has fewer than ``min_chars`` code points."""
    key = line.strip(BLANKS).lower()  # on bytes, lower() folds A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def line_keys(texts: DataFrame, min_chars: int) -> DataFrame:
    """(_d, _h, _pos, _key) for the lines of texts (_d, _h, _t) whose keys are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, keys = [], [], []
            for i, t in enumerate(b.column(2)):
                for p, line in enumerate(t.as_py().split(b"\n")):
                    if len(line) >= min_chars and (k := line_key(line, min_chars)):
                        row.append(i)
                        pos.append(p)
                        keys.append(k)
            at = pa.array(row, pa.int32())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(keys, pa.binary())], names=["__wl_d", "__wl_h", "__wl_pos", "__wl_key"])

    return map_batches(texts, run, widened(texts.select("__wl_d", "__wl_h"), "__wl_pos int, __wl_key binary"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines except those in the largest id holding it.
    Documents are told apart by id: rows that repeat an id count once, and every
    input row comes back.  A null or empty text is one empty line; a null id is a
    document that sorts before all others.  No rows in, no rows out.  Other
    columns pass through; ones that carry an output name are replaced.
    """
    base = docs.drop("kept_text", "n_lines", "n_dropped").withColumn("__wl_t", F.coalesce(F.col(text), F.lit("")))
    base = base.withColumn("__wl_h", F.xxhash64("__wl_t"))  # tells rows that share an id apart
    lines = cut(line_keys(base.select(F.col(doc_id).alias("__wl_d"), "__wl_h", F.col("__wl_t").cast("binary")), min_chars), "lines")
    # one row per document and key first, so that a hot key meets as one partial count per task
    counted = (
        lines.select("__wl_key", "__wl_d").distinct()
        .groupBy("__wl_key").agg(F.count(F.lit(1)).alias("__wl_n"), F.max("__wl_d").alias("__wl_last"))
        .filter(F.col("__wl_n") >= min_docs)
    )
    counted = cut(counted, "keys")
    heavy = F.col("__wl_n") > lines.count() // HEAVY
    hot = F.broadcast(counted.filter(heavy).withColumnsRenamed({"__wl_key": "__wl_hot", "__wl_last": "__wl_hot_last"}).drop("__wl_n"))
    marked = lines.join(hot, F.col("__wl_key") == F.col("__wl_hot"), "left")
    gone = F.col("__wl_d").isNull() | (F.col("__wl_d") != F.col("__wl_last"))
    flags = (
        marked.filter("__wl_hot is not null").select("__wl_d", "__wl_h", "__wl_pos", F.col("__wl_hot_last").alias("__wl_last"))
        .union(marked.filter("__wl_hot is null").join(counted.filter(~heavy), "__wl_key").select("__wl_d", "__wl_h", "__wl_pos", "__wl_last"))
        .filter(gone)
        .groupBy(F.col("__wl_d").alias("__wl_fd"), F.col("__wl_h").alias("__wl_fh")).agg(F.sort_array(F.collect_set("__wl_pos")).alias("__wl_drop"))
    )
    joined = base.join(flags.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col("__wl_fd")) & (F.col("__wl_h") == F.col("__wl_fh")), "left")
    # reassembly by position: the runs between dropped positions, joined in order
    parts = F.split("__wl_t", "\n", -1)
    n = F.size(parts)
    drop = F.coalesce(F.col("__wl_drop"), F.array().cast("array<int>"))
    bounds = F.concat(F.array(F.lit(-1)), drop, F.array(n))
    runs = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(drop)), lambda i: F.struct(
            (F.get(bounds, i) + 1).alias("a"), (F.get(bounds, i + 1) - F.get(bounds, i) - 1).alias("n"))),
        lambda r: r["n"] > 0,
    )
    kept = F.array_join(F.transform(runs, lambda r: F.array_join(F.slice(F.col("__wl_lines"), r["a"] + 1, r["n"]), "\n")), "\n")
    return (
        joined.withColumn("__wl_lines", parts)
        .withColumns({"n_lines": n.cast("long"), "n_dropped": F.size(drop).cast("long"),
                      "kept_text": F.when(F.size(drop) == 0, F.col("__wl_t")).otherwise(kept)})
        .drop("__wl_t", "__wl_h", "__wl_fd", "__wl_fh", "__wl_drop", "__wl_lines")
    )
