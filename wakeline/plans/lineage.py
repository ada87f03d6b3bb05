"""Artifact lineage: who wrote and read what, when, how often, and how deep it sits."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from .metrics import q6, quantiles

REUSE_CLASSES = ["dead_write", "produced_read_once", "produced_read_many", "input_read_once", "input_read_many"]


def io_events(fs: DataFrame, prefixes: list[str] = ["/work"], excluded: list[str] = []) -> DataFrame:
    """Reads and writes that moved bytes of workload files, or of relative paths inside a task."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("path").startswith(p)
    for x in excluded:
        keep = keep & ~F.col("path").contains(x)
    if "execution_unit_id" in fs.columns:
        keep = keep | (~F.col("path").startswith("/") & F.col("execution_unit_id").isNotNull())
    calls = F.col("syscall").isin(C.LINEAGE_READS + C.LINEAGE_WRITES)
    return fs.filter(calls & (F.col("bytes_transferred") > 0) & keep).withColumn("kind", C.kind(F.col("syscall")))


def artifacts(fs: DataFrame, sizes: DataFrame | None = None, dead_fraction: float = 0.05, prefixes: list[str] = ["/work"]) -> DataFrame:
    """One row per file of a run: volumes, readers and writers, category, size, reuse and lifecycle.

    ``sizes`` (path, size) holds true sizes from outside; generated files fall back to
    the bytes written, others stay unknown.
    """
    ev = io_events(fs, prefixes)
    r, w, b = F.col("kind") == "read", F.col("kind") == "write", F.col("bytes_transferred")
    ts = F.col("ts_ms") / 1000
    art = ev.groupBy("run_id", "path").agg(
        F.count_if(r).alias("n_reads"), F.count_if(w).alias("n_writes"), F.sum(F.when(r, b).otherwise(0)).alias("read_bytes"), F.sum(F.when(w, b).otherwise(0)).alias("write_bytes"),
        F.count_distinct(F.when(r, F.col("tool_call"))).alias("reader_calls"), F.count_distinct(F.when(w, F.col("tool_call"))).alias("writer_calls"), F.count_distinct("tool_call").alias("touching_calls"),
        F.count_distinct(F.when(r, F.col("role"))).alias("reader_roles"), F.count_distinct(F.when(w, F.col("role"))).alias("writer_roles"),
        F.min(F.when(w, ts)).alias("first_write"), F.min(F.when(r, ts)).alias("first_read"), F.max(F.when(r, ts)).alias("last_read"),
    )
    span = ev.groupBy("run_id").agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"))
    art = art.join(span, "run_id")
    if sizes is not None:
        art = art.join(sizes.select("path", F.col("size").alias("known_size")), "path", "left")
    else:
        art = art.withColumn("known_size", F.lit(None).cast("long"))
    reads, writes = F.col("n_reads"), F.col("n_writes")
    reclaim = F.when(writes == 0, None).when(reads == 0, F.col("first_write")).otherwise(F.col("last_read"))
    dead = F.when(writes == 0, 0.0).otherwise(F.greatest(F.col("run_end") - reclaim, F.lit(0.0)))
    size = F.when(F.col("write_bytes") > 0, F.col("write_bytes")).otherwise(F.col("read_bytes"))
    out = art.withColumns({
        "category": C.artifact_category(F.col("path"), reads), "file_kind": C.file_kind(F.col("path")), "size_bytes": size,
        "true_size": F.coalesce("known_size", F.when(writes > 0, F.col("write_bytes"))),
        "size_source": F.when(F.col("known_size").isNotNull(), "stat").when(writes > 0, "write_bytes").otherwise("unknown"),
        "reuse_class": C.reuse_class(reads, writes, F.col("reader_calls")), "t_create": F.coalesce("first_write", "first_read"), "dead_seconds": dead,
    })
    live = F.when(writes == 0, "input").when(reads == 0, "ephemeral_leaf").when(F.col("dead_seconds") > dead_fraction * F.greatest(F.col("run_end") - F.col("run_start"), F.lit(1e-9)), "transient").otherwise("live_to_end")
    return out.withColumns({
        "lifecycle_class": live, "waste_byte_seconds": F.col("size_bytes") * F.col("dead_seconds"),
        "read_amplification": F.when(F.col("read_bytes") > 0, F.try_divide("read_bytes", F.nullif(F.col("true_size"), F.lit(0)))),
    })


def reuse_summary(art: DataFrame) -> DataFrame:
    """Files and bytes of every reuse class, absent ones as zeros."""
    found = art.groupBy("run_id", "reuse_class").agg(F.count(F.lit(1)).alias("files"), F.sum("read_bytes").alias("read_bytes"), F.sum("write_bytes").alias("write_bytes"))
    grid = art.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, REUSE_CLASSES))).alias("reuse_class"))
    return grid.join(found, ["run_id", "reuse_class"], "left").na.fill(0, ["files", "read_bytes", "write_bytes"])


def reuse_factor(art: DataFrame) -> DataFrame:
    dead = F.sum(F.when(F.col("reuse_class") == "dead_write", F.col("write_bytes")).otherwise(0))
    unique = F.sum(F.when(F.col("read_bytes") > 0, F.coalesce("true_size", F.lit(0))).otherwise(0))
    return art.groupBy("run_id").agg(dead.alias("dead_write_bytes"), q6(F.try_divide(100 * dead, F.sum("write_bytes"))).alias("dead_write_pct"), unique.alias("unique_read_bytes"),
                                     q6(F.try_divide(F.sum("read_bytes"), unique)).alias("read_reuse_factor"), F.count_if((F.col("size_source") == "unknown") & (F.col("n_reads") > 0)).alias("unknown_inputs"))


def size_knownness(art: DataFrame) -> DataFrame:
    return art.groupBy("run_id", "size_source").agg(F.count(F.lit(1)).alias("files"), F.sum("true_size").alias("bytes"))


def lifecycle_summary(art: DataFrame) -> DataFrame:
    return art.groupBy("run_id", "lifecycle_class").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), *quantiles(F.col("dead_seconds"), 0.5, 0.95), q6(F.sum("waste_byte_seconds") / 1e9).alias("waste_gbs"))


def write_read_gaps(fs: DataFrame) -> DataFrame:
    """Seconds from the latest earlier write of a file to each of its reads: an as-of join by window."""
    ev = io_events(fs)
    order = Window.partitionBy("run_id", "path").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.last(F.when(F.col("kind") == "write", F.col("ts_ms")), True).over(order)
    gap = (F.col("ts_ms") - F.col("wrote")) / 1000
    return ev.withColumn("wrote", wrote).filter("kind = 'read' and wrote is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *quantiles(gap, 0.5, 0.95), q6(F.max(gap)).alias("max_s"))


def write_read_histogram(fs: DataFrame) -> DataFrame:
    ev = io_events(fs)
    order = Window.partitionBy("run_id", "path").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.last(F.when(F.col("kind") == "write", F.col("ts_ms")), True).over(order)
    found = ev.withColumn("wrote", wrote).filter("kind = 'read' and wrote is not null").groupBy("run_id", C.time_bin((F.col("ts_ms") - F.col("wrote")) / 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ev.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(b) for *_, b in C.TIME_BINS))).alias("bin"))
    return grid.join(found, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def fanout(art: DataFrame) -> DataFrame:
    """Files by numbers of writers and readers (1-1, 1-n, n-1, n-n) with the spread of readers."""
    shape = F.concat(F.when(F.col("writer_calls") <= 1, "1").otherwise("n"), F.lit("-"), F.when(F.col("reader_calls") <= 1, "1").otherwise("n"))
    x = F.col("reader_calls")
    return art.groupBy("run_id", shape.alias("shape")).agg(F.count(F.lit(1)).alias("files"), q6(F.avg(x)).alias("mean"), *quantiles(x, 0.5, 0.95), F.max(x).alias("max"))


def fanout_joint(art: DataFrame) -> DataFrame:
    return art.groupBy("run_id", "writer_calls", "reader_calls").agg(F.count(F.lit(1)).alias("files"))


def role_io(fs: DataFrame, art: DataFrame) -> DataFrame:
    """Bytes by role and category, with subtotals by role and run (``level`` tells them apart)."""
    ev = io_events(fs).drop("category").join(art.select("run_id", "path", "category"), ["run_id", "path"])
    r, b = F.col("kind") == "read", F.col("bytes_transferred")
    out = ev.rollup("run_id", "role", "category").agg(F.grouping_id().alias("level"), F.sum(F.when(r, b).otherwise(0)).alias("read_bytes"), F.sum(F.when(~r, b).otherwise(0)).alias("write_bytes"))
    return out.filter("level < 7")


def top_roles(fs: DataFrame) -> DataFrame:
    """The role that reads and the one that writes most in each run."""
    by = io_events(fs).groupBy("run_id", "kind", "role").agg(F.sum("bytes_transferred").alias("bytes"))
    order = Window.partitionBy("run_id", "kind").orderBy(F.desc("bytes"), "role")
    return by.withColumn("i", F.row_number().over(order)).filter("i = 1").drop("i")


def volume(fs: DataFrame) -> DataFrame:
    """Workload bytes each way and their share of everything the process tree moved."""
    r, w, b = F.col("syscall").isin(C.LINEAGE_READS), F.col("syscall").isin(C.LINEAGE_WRITES), F.col("bytes_transferred")
    everything = fs.groupBy("run_id").agg(F.sum(F.when(r | w, b).otherwise(0)).alias("all_bytes"))
    own = io_events(fs).groupBy("run_id").agg(F.sum(F.when(r, b).otherwise(0)).alias("read_bytes"), F.sum(F.when(w, b).otherwise(0)).alias("write_bytes"))
    return own.join(everything, "run_id").select("*", q6(F.try_divide("read_bytes", "write_bytes")).alias("read_write_ratio"), q6(F.try_divide(100 * (F.col("read_bytes") + F.col("write_bytes")), "all_bytes")).alias("coverage_pct"))


def namespace(fs: DataFrame) -> DataFrame:
    """Creates, renames, unlinks and mkdirs, and the spread of files per tool call."""
    s = F.col("syscall")
    per = fs.filter("tool_call is not null").groupBy("run_id", "tool_call").agg(F.count_distinct("path").alias("n"))
    spread = per.groupBy("run_id").agg(*quantiles(F.col("n"), 0.5, 0.95), F.max("n").alias("max_files"))
    ops = fs.groupBy("run_id").agg(F.count_if(s.isin("open", "openat") & (F.coalesce("return_value", F.lit(-1)) >= 0)).alias("creates"), F.count_if(s.isin("rename", "renameat", "renameat2")).alias("renames"),
                                   F.count_if(s.isin("unlink", "unlinkat")).alias("unlinks"), F.count_if(s.isin("mkdir", "mkdirat")).alias("mkdirs"))
    return ops.join(spread, "run_id", "left")


def directory_fanout(fs: DataFrame, k: int = 20) -> DataFrame:
    """The k directories of each run that hold most distinct files."""
    d = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    per = io_events(fs).groupBy("run_id", d.alias("dir")).agg(F.count_distinct("path").alias("files"))
    order = Window.partitionBy("run_id").orderBy(F.desc("files"), "dir")
    return per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tmp_lifetimes(fs: DataFrame) -> DataFrame:
    """Seconds from the last create of a file to its unlink."""
    s = F.col("syscall")
    order = Window.partitionBy("run_id", "path").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    made = F.last(F.when(s.isin("open", "openat"), F.col("ts_ms")), True).over(order)
    return fs.withColumn("made", made).filter(s.isin("unlink", "unlinkat") & F.col("made").isNotNull()).select("run_id", "path", ((F.col("ts_ms") - F.col("made")) / 1000).alias("seconds"))


def tool_call_io(fs: DataFrame) -> DataFrame:
    s, b = F.col("syscall"), F.col("bytes_transferred")
    r, w = s.isin(C.READS), s.isin(C.WRITES)
    return fs.groupBy("run_id", "tool_call").agg(F.count_if(r).alias("reads"), F.count_if(w).alias("writes"), F.count_if(C.is_storage_metadata(s)).alias("meta"), F.sum(F.when(r, b).otherwise(0)).alias("read_bytes"), F.sum(F.when(w, b).otherwise(0)).alias("write_bytes"))


def lineage_edges(fs: DataFrame) -> DataFrame:
    """(run_id, parent, child): one tool call read the parent and wrote the child.

    Readers and writers of a call are made distinct first; the join is on the call.
    """
    ev = io_events(fs).filter("tool_call is not null")
    r = ev.filter("kind = 'read'").select("run_id", "tool_call", F.col("path").alias("parent")).distinct()
    w = ev.filter("kind = 'write'").select("run_id", "tool_call", F.col("path").alias("child")).distinct()
    return r.join(w, ["run_id", "tool_call"]).filter("parent <> child").select("run_id", "parent", "child").distinct()


def condensed_depths(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Longest path to each node after strongly connected components are collapsed (Tarjan, iterative)."""
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    comp: dict[str, int] = {}
    held: list[str] = []
    number = -1
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    number += 1
                    while True:
                        x = held.pop()
                        comp[x] = number
                        if x == node:
                            break
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                held.append(nxt)
                work.append((nxt, iter(out[nxt])))
            elif nxt not in comp:
                low[node] = min(low[node], index[nxt])
    # Tarjan numbers components in reverse topological order
    above: dict[int, set[int]] = defaultdict(set)
    for a, b in edges:
        if comp[a] != comp[b]:
            above[comp[a]].add(comp[b])
    depth: dict[int, int] = defaultdict(int)
    for c in sorted(set(comp.values()), reverse=True):
        for b in above[c]:
            depth[b] = max(depth[b], depth[c] + 1)
    return {x: depth[c] for x, c in comp.items()}


def generations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, path, generation): hops from a raw input, cycles collapsed.  A run's file graph is one group."""
    def run(t: pa.Table) -> pa.Table:
        found = condensed_depths(list(zip(t.column("parent").to_pylist(), t.column("child").to_pylist(), strict=True)))
        return pa.table({"run_id": pa.array([t.column("run_id")[0].as_py()] * len(found), t.schema.field("run_id").type), "path": pa.array(list(found), pa.string()), "generation": pa.array(list(found.values()), pa.int32())})

    kind = edges.schema["run_id"].dataType.simpleString()
    got = edges.select("run_id", "parent", "child").groupBy("run_id").applyInArrow(run, f"run_id {kind}, path string, generation int")
    return nodes.select("run_id", "path").join(got, ["run_id", "path"], "left").select("run_id", "path", F.coalesce("generation", F.lit(0)).alias("generation"))


def most_touched(art: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc("touching_calls"), "path")
    return art.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("run_id", "rank", "path", "touching_calls")
