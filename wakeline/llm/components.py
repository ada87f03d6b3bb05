"""Connected components of an edge table.

Every task first replaces its edges by a forest of stars, which keeps what they connect.
While more than ``TASK_EDGES`` are left, alternating large and small stars, each a shuffle
of edges, and further forests shrink them; the rest is one task's work on a table of known
size.  Nothing reaches the driver but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches

#: Edges that one task takes at once (16 bytes each, and about ten times that while it works).
TASK_EDGES = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the edges: all nodes, ascending, and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _forests(edges: DataFrame, all_nodes: bool) -> DataFrame:
    """The forest of each partition as edges (a, b) to roots b; with ``all_nodes`` roots have a row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros((2, 0), np.int64)], 0

        def packed() -> np.ndarray:
            return np.stack(forest(*np.concatenate(held, axis=1)))

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size > TASK_EDGES:
                held = [packed()]
                size = held[0].shape[1] // 2  # so much must come anew before they are packed again
        nodes, roots = packed()
        keep = slice(None) if all_nodes else nodes != roots
        yield pa.record_batch([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])

    return map_batches(edges, run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    joined = both.join(least, F.col("a") == F.col("_a"))
    if large:  # neighbours above the node hang from its least neighbour
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:  # the node and its smaller neighbours hang from the least of them
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
    return out.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), two longs: root is the least node reachable.

    Loops and repeated edges are allowed (a node with nothing but loops may lack a row);
    edges with a null end are dropped; no edges, no rows.
    """
    now = cut(_forests(edges.select("a", "b").filter("a <> b"), False), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark[0] <= TASK_EDGES:
            return cut(_forests(now.coalesce(1), True), "components").withColumnsRenamed({"a": "node", "b": "root"})
        if tuple(mark) == before:
            break
        before = tuple(mark)
        now = cut(_forests(_star(_star(now, True), False), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
