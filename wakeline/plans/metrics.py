"""I/O metrics of runs: volumes, ratios, sizes, patterns, bursts, bandwidth.

Every function maps a typed event table (and, where needed, a table of artifacts or
intervals) to one aggregate table, partitioned by ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..operators import intervals as I

SYS = F.col
RUN = ["run_id"]


def q6(c: Column) -> Column:
    return F.round(c, 6)


def quantiles(c: Column, *ps: float) -> list[Column]:
    """Exact percentiles with linear interpolation; null on no rows."""
    return [q6(F.percentile(c, F.lit(p))).alias(f"p{round(p * 100)}") for p in ps]


def scoped(fs: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose path is an artifact of the run (Spark broadcasts the paths if they are small)."""
    return fs.join(paths.select("run_id", "path").distinct(), ["run_id", "path"], "left_semi")


def directories(paths: DataFrame) -> DataFrame:
    """All ancestors of the artifacts' paths, the root as '/'."""
    parts = F.split("path", "/", -1)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.filter("path <> ''").select("run_id", F.explode(cut).alias("dir")).select("run_id", F.when(F.col("dir") == "", "/").otherwise(F.col("dir")).alias("dir")).distinct()


def scoped_dirs(fs: DataFrame, paths: DataFrame) -> DataFrame:
    trimmed = F.when(F.col("path") == "/", "/").otherwise(F.regexp_replace("path", "/+$", ""))
    return fs.withColumn("_dir", trimmed).join(directories(paths).withColumnRenamed("dir", "_dir"), ["run_id", "_dir"], "left_semi").drop("_dir")


def data_ops(fs: DataFrame) -> DataFrame:
    """Reads and writes with their bytes, kind and interval."""
    return fs.filter(F.col("syscall").isin(C.READS + C.WRITES)).withColumns({
        "kind": C.kind(F.col("syscall")), "bytes": C.io_bytes(F.col("bytes_transferred"), F.lit(None).cast("long")),
        "s": F.col("ts_ms") - F.greatest(F.lit(0.0), F.col("dur_s") * 1000), "e": F.col("ts_ms"),
    })


def latency_by_phase(fs: DataFrame) -> DataFrame:
    label = C.phase_label(F.col("phase"), F.col("role"))
    return fs.filter("resource_bucket <> 'interface_probe'").groupBy("run_id", label.alias("label")).agg(F.count(F.lit(1)).alias("ops"), *quantiles(F.col("dur_s") * 1000, 0.5, 0.95, 0.99))


def bytes_ops_by_phase(fs: DataFrame) -> DataFrame:
    """Operations and bytes of the data calls by phase and role, zero-byte calls included."""
    size, write = C.io_bytes(F.col("bytes_transferred"), F.lit(None).cast("long")), F.col("syscall").isin(C.WRITES)
    return fs.filter(C.is_data(F.col("syscall"))).groupBy("run_id", C.phase_label(F.col("phase"), F.col("role")).alias("label")).agg(
        F.count(F.lit(1)).alias("ops"), F.count_if(~write).alias("read_ops"), F.count_if(write).alias("write_ops"),
        F.sum(F.when(~write, size).otherwise(0)).alias("read_bytes"), F.sum(F.when(write, size).otherwise(0)).alias("write_bytes"),
    )


def op_ratios(fs: DataFrame) -> DataFrame:
    s = F.col("syscall")
    out = fs.groupBy("run_id").agg(F.count_if(C.category(s) == "metadata").alias("strict_metadata_ops"), F.count_if(C.is_storage_metadata(s)).alias("storage_metadata_ops"), F.count_if(C.is_data(s)).alias("data_ops"))
    return out.select("*", q6(F.try_divide("strict_metadata_ops", "data_ops")).alias("strict_ratio"), q6(F.try_divide("storage_metadata_ops", "data_ops")).alias("storage_ratio"))


def ops_by_category(fs: DataFrame) -> DataFrame:
    return fs.groupBy("run_id", C.category(F.col("syscall")).alias("category"), C.resource_bucket(F.col("syscall")).alias("bucket")).agg(F.count(F.lit(1)).alias("ops"), q6(F.sum("dur_s")).alias("seconds"))


def request_sizes(fs: DataFrame) -> DataFrame:
    """Summary of request sizes by kind and over both (grouping sets, told apart by ``kind`` = all)."""
    ops = data_ops(fs).withColumn("size", C.request_bytes(F.col("requested_size"), F.lit(None).cast("long"), F.col("bytes_transferred")).cast("double")).filter("size > 0")
    x = F.col("size")
    share = lambda n: q6(100 * F.avg((x < n).cast("int")))
    out = ops.rollup("run_id", "kind").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *quantiles(x, 0.5, 0.95, 0.99),
        share(4096).alias("pct_lt_4kb"), share(1 << 16).alias("pct_lt_64kb"), share(1 << 20).alias("pct_lt_1mb"),
        q6(F.sum(x * x) / F.sum(x)).alias("weighted_mean"),
    )
    return out.filter("g < 3").withColumn("kind", F.when(F.col("g") == 1, "all").otherwise(F.col("kind"))).drop("g")


def request_size_cdf(fs: DataFrame) -> DataFrame:
    """101 points of the distribution of request sizes of each run."""
    ops = data_ops(fs).withColumn("size", C.request_bytes(F.col("requested_size"), F.lit(None).cast("long"), F.col("bytes_transferred")).cast("double")).filter("size > 0")
    points = F.percentile("size", F.array(*(F.lit(i / 100) for i in range(101))))
    return ops.groupBy("run_id").agg(points.alias("v")).select("run_id", F.posexplode("v").alias("pct", "bytes")).withColumn("bytes", q6(F.col("bytes")))


def size_histogram(fs: DataFrame) -> DataFrame:
    ops = data_ops(fs).filter("bytes > 0")
    return ops.groupBy("run_id", "kind", C.size_bin(F.col("bytes")).alias("bin")).agg(F.count(F.lit(1)).alias("ops"), F.sum("bytes").alias("bytes"))


def file_sizes(artifacts: DataFrame) -> DataFrame:
    size = F.coalesce("true_size", "size_bytes").cast("double")
    return artifacts.filter(size > 0).groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), *quantiles(size, 0.5, 0.95, 0.99), F.sum(size).cast("long").alias("bytes"))


def byte_normalized(fs: DataFrame) -> DataFrame:
    """Operations per GiB moved and shares of bytes; null where nothing was moved."""
    size, s = F.col("bytes_transferred"), F.col("syscall")
    gib = F.sum(F.when(C.is_data(s), size).otherwise(0)) / float(1 << 30)
    out = fs.groupBy("run_id").agg(
        F.sum(F.when(s.isin(C.READS), size).otherwise(0)).alias("read_bytes"), F.sum(F.when(s.isin(C.WRITES), size).otherwise(0)).alias("write_bytes"),
        F.count_if(C.is_data(s) & (size > 0)).alias("data_ops"), F.count_if(C.is_storage_metadata(s)).alias("meta_ops"), F.count_if(s.isin(C.OPEN_CLOSE)).alias("opens"), gib.alias("gib"),
    )
    return out.select("run_id", "read_bytes", "write_bytes", *(q6(F.try_divide(c, "gib")).alias(f"{c}_per_gib") for c in ("data_ops", "meta_ops", "opens")),
                      q6(F.try_divide("read_bytes", F.col("read_bytes") + F.col("write_bytes"))).alias("read_share"))


def per_gib_by_phase(fs: DataFrame) -> DataFrame:
    """Phase cuts with their rates per GiB of the run."""
    by = bytes_ops_by_phase(fs)
    gib = by.groupBy("run_id").agg((F.sum(F.col("read_bytes") + F.col("write_bytes")) / float(1 << 30)).alias("gib"))
    return by.join(gib, "run_id").select("run_id", "label", "ops", q6(F.try_divide("ops", "gib")).alias("ops_per_gib"))


def fs_time_outside_llm(fs: DataFrame, llm: DataFrame) -> DataFrame:
    """Busy file-I/O seconds over the run's wall time without inference."""
    io = I.union_length(data_ops(fs).filter("bytes > 0"), RUN).withColumnRenamed("length", "io_ms")
    wall = fs.groupBy("run_id").agg((F.max("ts_ms") - F.min("ts_ms")).alias("wall_ms"))
    busy = I.union_length(llm, RUN).withColumnRenamed("length", "llm_ms")
    out = wall.join(io, "run_id", "left").join(busy, "run_id", "left").na.fill(0.0, ["io_ms", "llm_ms"])
    return out.select("run_id", q6(F.col("io_ms") / 1000).alias("io_s"), q6((F.col("wall_ms") - F.col("llm_ms")) / 1000).alias("non_llm_s"), q6(F.try_divide("io_ms", F.col("wall_ms") - F.col("llm_ms"))).alias("share"))


def interface_mix(fs: DataFrame) -> DataFrame:
    """Bytes and calls by interface; a layer is named by the call."""
    layer = F.when(F.col("syscall").isin("fread", "fwrite"), "STDIO").when(F.col("syscall").startswith("H5D"), "HDF5").when(F.col("syscall").startswith("MPI_File"), "MPI-IO").when(F.col("syscall") == "mmap", "MMAP").when(C.is_data(F.col("syscall")), "POSIX")
    write = F.lower("syscall").contains("write")
    return fs.withColumns({"layer": layer, "b": C.interface_bytes(F.col("return_value"), F.col("bytes_transferred"))}).filter("layer is not null and b >= 0").groupBy("run_id", "layer", F.col("syscall").alias("function")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(~write, F.col("b")).otherwise(0)).alias("read_bytes"), F.sum(F.when(write, F.col("b")).otherwise(0)).alias("write_bytes")
    )


def directory_scans(fs: DataFrame) -> DataFrame:
    per = fs.filter(F.col("syscall").isin(C.DIRECTORY_SCANS)).groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("run_id").agg(F.sum("n").alias("total_scans"), F.sum(F.col("n") - 1).alias("rescan_ops"), F.count(F.lit(1)).alias("directories"), F.count_if(F.col("n") > 1).alias("rescanned"),
                                     F.count_if(F.col("n") >= 10).alias("ten_or_more"), q6(F.percentile("n", F.lit(0.95))).alias("p95"))


def directory_scan_histogram(fs: DataFrame) -> DataFrame:
    """Directories by number of scans, every bin from 1 to 9 and >=10 present."""
    per = fs.filter(F.col("syscall").isin(C.DIRECTORY_SCANS)).groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy("run_id", F.when(F.col("n") >= 10, ">=10").otherwise(F.col("n").cast("string")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = per.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(str(i)) for i in range(1, 10)), F.lit(">=10"))).alias("bin"))
    return bins.join(found, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("n", F.lit(0)).alias("directories"))


def failed_probes(fs: DataFrame) -> DataFrame:
    """Failed opens and stats, an interpreter's import probes told apart."""
    probe, failed = C.is_import_probe(F.col("path")), F.col("return_value") < 0
    return fs.filter(F.col("syscall").isin(C.OPEN_STAT)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failed_raw"), F.count_if(failed & probe).alias("import_probes"), F.count_if(failed & ~probe).alias("failed"),
        q6(F.try_divide(F.count_if(failed & ~probe), F.count_if(~probe))).alias("failed_rate"), F.count_distinct(F.when(failed & ~probe, F.col("path"))).alias("paths"),
    )


def top_failing_paths(fs: DataFrame, k: int = 5) -> DataFrame:
    bad = fs.filter(F.col("syscall").isin(C.OPEN_STAT) & (F.col("return_value") < 0) & ~C.is_import_probe(F.col("path")))
    n = bad.groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "path"))).filter(F.col("rank") <= k)


def failures_by_errno(fs: DataFrame) -> DataFrame:
    bad = fs.filter(F.col("syscall").isin(C.OPEN_STAT) & (F.col("return_value") < 0) & ~C.is_import_probe(F.col("path")))
    name = F.abs("return_value")
    out = F
    for n, label in C.ERRNO.items():
        out = out.when(name == n, label)
    return bad.groupBy("run_id", "syscall", out.otherwise(name.cast("string")).alias("errno")).agg(F.count(F.lit(1)).alias("n"))


def error_log_reads(artifacts: DataFrame) -> DataFrame:
    logs = artifacts.filter("category = 'logs'")
    return logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("log_files"), F.count_if(F.col("n_reads") > 0).alias("ever_read"), F.sum("n_reads").alias("reads"), F.sum("read_bytes").alias("read_bytes"))


def state_file_rewrites(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter(C.any_of(C.STATE_FILE_HINTS, F.lower("path"))).select("run_id", "path", "n_writes", "n_reads", "write_bytes", "read_bytes")


def reread_attribution(fs: DataFrame) -> DataFrame:
    """Rereads of a file: reopened in the same step, after a backtrack, or by another step."""
    touch = (
        fs.filter(F.col("syscall").isin(C.READS)).groupBy("run_id", "path", "tool_call", "fd")
        .agg(F.min("ts_ms").alias("first"), F.sum("bytes_transferred").alias("bytes"), F.min("phase").alias("phase"))
    )
    order = Window.partitionBy("run_id", "path").orderBy("first", "tool_call", "fd")
    before = F.lag("tool_call").over(order)
    how = F.when(before == F.col("tool_call"), "same_step_reopen").when(F.col("phase") == "action_unit_backtrack", "reread_after_backtrack").otherwise("different_tool_call")
    return touch.withColumns({"before": before, "how": how}).filter("before is not null").groupBy("run_id", "how").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_distinct("path").alias("files"))


def same_file_reopen(fs: DataFrame) -> DataFrame:
    streams = fs.filter(F.col("syscall").isin(C.READS) & (F.col("bytes_transferred") > 0)).groupBy("run_id", "path", "pid", "fd", "open_generation").agg(F.min("ts_ms").alias("first"), F.sum("bytes_transferred").alias("bytes"))
    order = Window.partitionBy("run_id", "path").orderBy("first", "pid", "fd", "open_generation")
    again = F.col("i") > 1
    return streams.withColumn("i", F.row_number().over(order)).groupBy("run_id").agg(
        F.count_distinct(F.when(again, F.col("path"))).alias("files"), F.count_if(again).alias("reopens"), F.sum(F.when(again, F.col("bytes")).otherwise(0)).alias("bytes"),
        q6(100 * F.sum(F.when(again, F.col("bytes")).otherwise(0)) / F.sum("bytes")).alias("share_pct"),
    )


def exploration_overhead(fs: DataFrame, artifacts: DataFrame) -> DataFrame:
    by = bytes_ops_by_phase(fs).withColumn("b", F.col("read_bytes") + F.col("write_bytes"))
    total = by.groupBy("run_id").agg(F.sum("b").alias("total_bytes"), F.sum(F.when(F.col("label").contains("action_unit_backtrack"), F.col("b")).otherwise(0)).alias("backtrack_bytes"))
    dead = artifacts.filter("reuse_class = 'dead_write'").groupBy("run_id").agg(F.sum("write_bytes").alias("dead_write_bytes"))
    out = total.join(dead, "run_id", "left").na.fill(0, ["dead_write_bytes"])
    return out.withColumn("overhead", q6(F.try_divide(F.col("backtrack_bytes") + F.col("dead_write_bytes"), "total_bytes")))


def access_types(artifacts: DataFrame) -> DataFrame:
    """Read-heavy, write-heavy and mixed files by their bytes (two thirds, one third)."""
    r, w = F.col("read_bytes"), F.col("write_bytes")
    cls = F.when(3 * r >= 2 * (r + w), "read_heavy").when(3 * r <= r + w, "write_heavy").otherwise("read_write")
    return artifacts.filter((r > 0) | (w > 0)).groupBy("run_id", cls.alias("cls")).agg(F.count(F.lit(1)).alias("files"), F.sum(r + w).alias("bytes"))


def _streams(fs: DataFrame, owner: str) -> DataFrame:
    ops = data_ops(fs).filter((F.col("resource_bucket") == "file_io") & (F.col("bytes") > 0) & F.col("offset").isNotNull())
    return ops.withColumn("owner", F.col(owner))


def sequentiality(fs: DataFrame, owner: str = "tid") -> DataFrame:
    """Consecutive, forward-gap and backward transitions of each stream (kind, owner, fd, generation, path);
    an appending write counts as sequential and starts the stream anew."""
    keys = ["run_id", "kind", "owner", "fd", "open_generation"]
    order = Window.partitionBy(*keys).orderBy("ts_ms", "event_id")
    app = (F.col("kind") == "write") & F.col("append")
    ops = _streams(fs, owner).withColumn("app", app).withColumns({"prev": F.lag(F.when(~F.col("app"), F.col("offset") + F.col("bytes"))).over(order)})
    step = F.when(F.col("app") | F.col("prev").isNull(), F.lit(None)).otherwise(F.col("offset") - F.col("prev"))
    out = ops.withColumn("step", step).groupBy("run_id", "kind").agg(
        F.count(F.lit(1)).alias("ops"), F.count_if(F.col("step") == 0).alias("consecutive"), F.count_if(F.col("step") > 0).alias("gap"), F.count_if(F.col("step") < 0).alias("backward"), F.count_if(F.col("app")).alias("appends"),
    )
    moves = F.col("consecutive") + F.col("gap") + F.col("backward")
    return out.select("*", q6(F.try_divide(100 * F.col("consecutive"), moves)).alias("pct_consecutive"), q6(F.try_divide(100 * F.col("backward"), moves)).alias("pct_backward"))


def stride_histogram(fs: DataFrame, owner: str = "tid") -> DataFrame:
    keys = ["run_id", "kind", "owner", "fd", "open_generation"]
    order = Window.partitionBy(*keys).orderBy("ts_ms", "event_id")
    app = (F.col("kind") == "write") & F.col("append")
    ops = _streams(fs, owner).withColumn("app", app).withColumn("prev", F.lag(F.when(~F.col("app"), F.col("offset") + F.col("bytes"))).over(order))
    gap = F.col("offset") - F.col("prev")
    return ops.filter(~F.col("app") & (gap > 0)).groupBy("run_id", C.size_bin(gap).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mergeability(fs: DataFrame, cap: int = 4 << 20) -> DataFrame:
    """Operations saved if consecutive ones were merged up to ``cap`` bytes; appends do not break a run."""
    keys = ["run_id", "kind", "owner", "fd", "open_generation"]
    order = Window.partitionBy(*keys).orderBy("ts_ms", "event_id")
    ops = _streams(fs, "tid").withColumn("new", F.when(F.col("offset") == F.lag(F.col("offset") + F.col("bytes")).over(order), 0).otherwise(1))
    runs = ops.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("b") / cap)).cast("long")
    return runs.withColumn("chunks", chunks).groupBy("run_id", "kind").agg(
        F.sum("n").alias("ops"), F.sum("chunks").alias("merged_ops"), F.sum(F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("chunks"))).alias("saved_ops"), F.sum("b").alias("bytes"),
        F.sum(F.when(F.col("n") >= 2, F.col("b")).otherwise(0)).alias("bytes_in_runs"),
    )


def inter_arrival(fs: DataFrame) -> DataFrame:
    """Gaps between the distinct access times of a file, by kind and over both."""
    ops = data_ops(fs).select("run_id", "path", "ts_ms", "kind")
    ops = ops.unionAll(ops.withColumn("kind", F.lit("all"))).distinct()
    gap = (F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("run_id", "kind", "path").orderBy("ts_ms"))) / 1000
    return ops.withColumn("gap", gap).filter("gap is not null").groupBy("run_id", "kind").agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("n"), *quantiles(F.col("gap"), 0.5, 0.95, 0.99), q6(F.avg("gap")).alias("mean_s"), q6(100 * F.avg((F.col("gap") < 1).cast("int"))).alias("pct_lt_1s")
    )


def inter_arrival_histogram(fs: DataFrame) -> DataFrame:
    ops = data_ops(fs).select("run_id", "path", "ts_ms").distinct()
    gap = (F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("run_id", "path").orderBy("ts_ms"))) / 1000
    found = ops.withColumn("gap", gap).filter("gap is not null").groupBy("run_id", C.time_bin(F.col("gap")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = ops.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(b) for *_, b in C.TIME_BINS))).alias("bin"))
    return bins.join(found, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def binned_bytes(fs: DataFrame, window_s: float, kinds: list[str] = ["read", "write"], start: DataFrame | None = None) -> DataFrame:
    """(run_id, bin, bytes): bytes per fixed window from the run's first point (or ``start``: run_id, t0, t1), zeros filled in."""
    points = data_ops(fs).filter(F.col("kind").isin(kinds)).select("run_id", (F.col("ts_ms") / 1000).alias("t"), "bytes")
    walls = start if start is not None else points.groupBy("run_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    sums = points.join(walls, "run_id").groupBy("run_id", F.floor((F.col("t") - F.col("t0")) / window_s).alias("bin")).agg(F.sum("bytes").alias("bytes"))
    grid = walls.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / window_s))).alias("bin"))
    return grid.join(sums, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def autocorrelation(fs: DataFrame, window_s: float, kind: str, lags: int = 3) -> DataFrame:
    """Autocorrelation with the global mean and variance, for lags 1..``lags``; null without variance."""
    series = binned_bytes(fs, window_s, [kind])
    stats = series.groupBy("run_id").agg(F.avg("bytes").alias("m"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("run_id").orderBy("bin")
    dev = series.join(stats, "run_id").withColumn("d", F.col("bytes") - F.col("m"))
    dev = dev.select("run_id", "n", "d", *(F.lead("d", i).over(order).alias(f"d{i}") for i in range(1, lags + 1)))
    var = F.sum(F.col("d") * F.col("d"))
    return dev.groupBy("run_id").agg(F.first("n").alias("n_bins"), *(q6(F.try_divide(F.sum(F.col("d") * F.col(f"d{i}")), F.nullif(var, F.lit(0.0)))).alias(f"lag{i}") for i in range(1, lags + 1)))


def read_write_correlation(fs: DataFrame, window_s: float) -> DataFrame:
    """Pearson correlation of read and write bytes bin by bin, each series from its own first point, cut to the shorter."""
    r = binned_bytes(fs, window_s, ["read"]).withColumnRenamed("bytes", "x")
    w = binned_bytes(fs, window_s, ["write"]).withColumnRenamed("bytes", "y")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return r.join(w, ["run_id", "bin"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), q6(F.try_divide(F.covar_pop(x, y), F.sqrt(F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0))))).alias("xcorr"))


def intensity_phases(fs: DataFrame, window_s: float = 60.0) -> DataFrame:
    """Runs of bins at or above the 75th, and of active bins at or below the 25th, percentile of active bins."""
    series = binned_bytes(fs, window_s)
    limits = series.filter("bytes > 0").groupBy("run_id").agg(F.percentile("bytes", F.lit(0.75)).alias("hi"), F.percentile("bytes", F.lit(0.25)).alias("lo"), F.count(F.lit(1)).alias("active")).filter("active >= 4")
    b = F.col("bytes")
    marked = series.join(limits, "run_id")
    both = marked.withColumn("level", F.lit("high")).withColumn("on", b >= F.col("hi")).unionAll(marked.withColumn("level", F.lit("low")).withColumn("on", (b > 0) & (b <= F.col("lo"))))
    order = Window.partitionBy("run_id", "level").orderBy("bin")
    on = both.filter("on").withColumn("island", F.col("bin") - F.row_number().over(order))
    runs = on.groupBy("run_id", "level", "island").agg(F.count(F.lit(1)).alias("n"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    return runs.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("phases"), q6(F.avg("n")).alias("mean_bins"), F.max("n").alias("max_bins"), q6(F.first("hi")).alias("hi"), q6(F.first("lo")).alias("lo"))


def bursts(fs: DataFrame, thresholds: tuple[float, ...] = (1.0, 10.0, 60.0)) -> DataFrame:
    """Bursts separated by idle gaps longer than each threshold (seconds)."""
    ops = data_ops(fs).filter("bytes > 0").select("run_id", "s", "e").withColumn("threshold_s", F.explode(F.array(*map(F.lit, thresholds))))
    blocks = I.merged(ops, ["run_id", "threshold_s"], gap=F.col("threshold_s") * 1000, keep_empty=True)
    order = Window.partitionBy("run_id", "threshold_s").orderBy("s")
    x = blocks.select("run_id", "threshold_s", "s", "e", ((F.col("e") - F.col("s")) / 1000).alias("d"), ((F.col("s") - F.lag("e").over(order)) / 1000).alias("gap"))
    return x.groupBy("run_id", "threshold_s").agg(
        F.count(F.lit(1)).alias("n"), *quantiles(F.col("d"), 0.5, 0.95), q6(F.max("d")).alias("max_s"), q6(F.percentile("gap", F.lit(0.5))).alias("gap_p50"), q6(F.max("gap")).alias("gap_max"),
        q6(F.try_divide(F.sum("d"), (F.max("e") - F.min("s")) / 1000)).alias("duty_cycle"),
    )


def timeline(events: DataFrame, fs: DataFrame, skew_ms: float = 1000.0) -> DataFrame:
    """Wall of each run from its semantic events (run_id, s, e); a run whose I/O lies further than
    ``skew_ms`` outside that wall fails, as its clocks disagree."""
    wall = events.groupBy("run_id").agg(F.min("s").alias("ws"), F.max("e").alias("we"))
    io = fs.groupBy("run_id").agg(F.min("ts_ms").alias("fs0"), F.max("ts_ms").alias("fs1"))
    apart = F.least("we", "fs1") - F.greatest("ws", "fs0") < -skew_ms
    return wall.join(io, "run_id", "left").withColumn("we", F.when(F.coalesce(apart, F.lit(False)), F.raise_error(F.lit("clock skew between I/O and semantic events")).cast("double")).otherwise(F.col("we"))).select("run_id", "ws", "we", q6((F.col("we") - F.col("ws")) / 1000).alias("wall_s"))


def io_vs_inference(fs: DataFrame, llm: DataFrame, walls: DataFrame) -> DataFrame:
    """Share of time and bytes inside inference; bytes count where their call ends."""
    blocks = I.merged(llm, RUN).drop("island")
    ops = I.covered(data_ops(fs).filter("bytes > 0").select("run_id", "ts_ms", "bytes"), blocks, RUN, "ts_ms")
    io = ops.groupBy("run_id").agg(F.sum("bytes").alias("total"), F.sum(F.when(F.col("inside"), F.col("bytes")).otherwise(0)).alias("inside"))
    busy = blocks.groupBy("run_id").agg(F.sum(F.col("e") - F.col("s")).alias("llm_ms"))
    idle = I.gaps(llm, walls, RUN).groupBy("run_id").agg(F.count(F.lit(1)).alias("gaps"), q6(F.percentile(F.col("gap") / 1000, F.lit(0.5))).alias("gap_p50"), q6(F.max("gap") / 1000).alias("gap_max"))
    out = walls.join(io, "run_id", "left").join(busy, "run_id", "left").join(idle, "run_id", "left").na.fill(0.0, ["llm_ms"]).na.fill(0, ["total", "inside", "gaps"])
    wall = F.col("we") - F.col("ws")
    in_bw = F.try_divide("inside", "llm_ms")
    out_bw = F.try_divide(F.col("total") - F.col("inside"), F.greatest(wall - F.col("llm_ms"), F.lit(0.0)))
    return out.select("run_id", q6(F.try_divide(100 * F.col("llm_ms"), wall)).alias("pct_time"), q6(F.try_divide(100 * F.col("inside"), "total")).alias("pct_bytes"), F.col("inside").alias("bytes_inside"),
                      q6(F.try_divide(in_bw, F.nullif(out_bw, F.lit(0.0)))).alias("bandwidth_ratio"), "gaps", "gap_p50", "gap_max")


def effective_bandwidth(fs: DataFrame, cut: str | None = None, min_ops: int = 5, min_busy_s: float = 1e-3) -> DataFrame:
    """Bytes over busy, wall and summed call time by kind and ``cut`` (phase, role, ...); unreliable active rates are null."""
    ops = data_ops(fs).filter("bytes > 0").withColumn("cut", F.col(cut) if cut else F.lit("all"))
    keys = ["run_id", "cut", "kind"]
    busy = I.union_length(ops, keys).withColumn("busy_s", F.col("length") / 1000).drop("length")
    sums = ops.groupBy(*keys).agg(F.count(F.lit(1)).alias("ops"), F.sum("bytes").alias("bytes"), (F.sum(F.col("e") - F.col("s")) / 1000).alias("io_s"), ((F.max("e") - F.min("s")) / 1000).alias("wall_s"))
    ok = (F.col("ops") >= min_ops) & (F.col("busy_s") >= min_busy_s)
    return sums.join(busy, keys, "left").select(
        *keys, "ops", "bytes", q6(F.col("busy_s")).alias("busy_s"), q6(F.when(ok, F.try_divide("bytes", "busy_s"))).alias("active_bps"), q6(F.try_divide("bytes", "wall_s")).alias("wall_bps"),
        q6(F.try_divide("bytes", "io_s")).alias("call_bps"), q6(F.try_divide("busy_s", "wall_s")).alias("duty_cycle"), F.coalesce(ok, F.lit(False)).alias("reliable"),
    )


def tool_summaries(fs: DataFrame) -> DataFrame:
    """Calls, time, bytes and latency percentiles by tool call and system call."""
    return fs.groupBy("run_id", "tool_call", "syscall").agg(F.count(F.lit(1)).alias("n"), q6(F.sum("dur_s") * 1000).alias("ms"), F.sum("bytes_transferred").alias("bytes"), *quantiles(F.col("dur_s") * 1000, 0.5, 0.95, 0.99))


def tool_residuals(fs: DataFrame, tools: DataFrame, code_tools: tuple[str, ...] = ("Bash", "CodeExec")) -> DataFrame:
    """Measured milliseconds by resource of each tool call; what is left of its duration is cpu for code tools, else unaccounted."""
    by = fs.groupBy("run_id", F.col("tool_call").alias("tool_id")).agg(F.sum(F.when(F.col("resource_bucket") == "file_io", F.col("dur_s") * 1000).otherwise(0.0)).alias("file_io_ms"), F.sum(F.col("dur_s") * 1000).alias("all_ms"))
    out = tools.join(by, ["run_id", "tool_id"], "left").na.fill(0.0, ["file_io_ms", "all_ms"])
    rest = F.greatest(F.lit(0.0), F.col("e") - F.col("s") - F.col("all_ms"))
    code = F.col("tool_name").isin(*code_tools)
    return out.select("run_id", "tool_id", q6(F.col("file_io_ms")).alias("file_io_ms"), q6(F.when(code, rest).otherwise(0.0)).alias("cpu_ms"), q6(F.when(code, 0.0).otherwise(rest)).alias("unaccounted_ms"))


def resource_time(fs: DataFrame) -> DataFrame:
    return fs.groupBy("run_id", "resource_bucket", F.col("tool_call").isNotNull().alias("in_tool")).agg(q6(F.sum("dur_s")).alias("seconds"))


def file_volume(fs: DataFrame) -> DataFrame:
    """Bytes each way, opens and read-write asymmetry of each file."""
    s, b = F.col("syscall"), F.col("bytes_transferred")
    out = fs.groupBy("run_id", "path").agg(F.sum(F.when(s.isin(C.READS), b).otherwise(0)).alias("r"), F.sum(F.when(s.isin(C.WRITES), b).otherwise(0)).alias("w"), F.count_if(s.isin("open", "openat")).alias("opens"))
    return out.filter("r + w > 0").withColumn("asymmetry", q6((F.col("r") - F.col("w")) / (F.col("r") + F.col("w"))))


def verdicts(fs: DataFrame) -> DataFrame:
    """Rules over the metrics of a run; unknown where a metric is missing."""
    seq = sequentiality(fs).filter("kind = 'read'").select("run_id", "pct_consecutive")
    out = op_ratios(fs).join(seq, "run_id", "left")
    meta = F.when(F.col("storage_ratio").isNull(), "unknown").when(F.col("storage_ratio") > 1, "metadata_bound").otherwise("data_bound")
    pattern = F.when(F.col("pct_consecutive").isNull(), "unknown").when(F.col("pct_consecutive") >= 50, "sequential").otherwise("random")
    return out.select("run_id", meta.alias("metadata"), pattern.alias("pattern"))
