"""Known answers and naive folds for the operators."""

import random

import pytest
from pyspark.sql import functions as F
from wakeline.functions import classify as C
from wakeline.functions import code, prompts
from wakeline.operators import attribution, folds
from wakeline.operators import intervals as I
from wakeline.plans import concurrency, lineage, metrics, prefix, quality, replay


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def spans(spark, values):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in values], "run_id int, s double, e double")


def test_union_and_degree(spark):
    df = spans(spark, [(0, 5), (3, 4), (4, 8), (10, 11), (12, 12)])
    assert rows(I.union_length(df, ["run_id"])) == [(1, 9.0)]
    assert rows(I.merged(df, ["run_id"]).select("s", "e")) == [(0.0, 8.0), (10.0, 11.0)]
    assert rows(I.k_active(df, ["run_id"], 2)) == [(1, 2.0)]
    assert rows(I.degree(df, ["run_id"]).select("max_degree", "two_or_more", "busy")) == [(2, 2.0, 9.0)]


def test_peak_concurrency_ends_before_starts(spark):
    assert rows(I.peak(spans(spark, [(0, 100), (50, 150), (200, 210)]), ["run_id"]))[0][1] == 2
    assert rows(I.peak(spans(spark, [(0, 100), (100, 200)]), ["run_id"]))[0][1] == 1


def test_subtract_matches_a_naive_count(spark):
    rng = random.Random(3)
    own = [(i, float(a), float(a + rng.randint(1, 40))) for i, a in enumerate(rng.randrange(100) for _ in range(30))]
    holes = [(rng.randrange(30), float(a), float(a + rng.randint(1, 15))) for a in (rng.randrange(120) for _ in range(60))]
    got = dict(rows(I.subtract(spark.createDataFrame(own, "id int, s double, e double"), spark.createDataFrame(holes, "id int, s double, e double"), ["id"]).groupBy("id").agg(F.sum(F.col("e") - F.col("s")))))
    for i, s, e in own:
        left = sum(1 for t in range(int(s), int(e)) if not any(h == i and a <= t < z for h, a, z in holes))
        assert got.get(i, 0.0) == left


def test_points_in_intervals_include_both_ends(spark):
    pts = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 3, 5, 6)], "run_id int, t double")
    blocks = spans(spark, [(1, 2), (5, 5.5)])
    assert [r[1] for r in rows(I.covered(pts, blocks, ["run_id"])) if r[2]] == [1.0, 2.0, 5.0]


def test_range_join_equals_the_nested_loop(spark):
    rng = random.Random(1)
    p = [(1, i, rng.uniform(0, 1000)) for i in range(300)]
    q = [(1, i, s, s + rng.uniform(0, 200)) for i, s in enumerate(rng.uniform(0, 1000) for _ in range(40))]
    got = rows(I.range_join(spark.createDataFrame(p, "run_id int, p int, t double"), spark.createDataFrame(q, "run_id int, q int, s double, e double"), ["run_id"], 37.0).select("p", "q"))
    assert got == sorted((a, b) for _, a, t in p for _, b, s, e in q if s <= t <= e)


def test_gaps_cover_the_rest_of_the_wall(spark):
    walls = spark.createDataFrame([(1, 0.0, 20.0), (2, 0.0, 4.0)], "run_id int, ws double, we double")
    assert rows(I.gaps(spans(spark, [(2, 5), (4, 8), (10, 11)]), walls, ["run_id"])) == [(1, 2.0), (1, 2.0), (1, 9.0), (2, 4.0)]


def test_stack_distances():
    assert prefix.stack_distances(list("abcaba")).tolist() == [-1, -1, -1, 2, 2, 1] and not len(prefix.stack_distances([]))
    rng = random.Random(4)
    keys = [rng.randrange(12) for _ in range(200)]
    for i, d in enumerate(prefix.stack_distances(keys)):
        before = [j for j in range(i) if keys[j] == keys[i]]
        assert d == (len(set(keys[before[-1] + 1 : i])) if before else -1)


def tokens(spark, seqs, extra=()):
    return spark.createDataFrame([(1, i, [str(x) for x in s], len(s), *(e[i] for e in extra)) for i, s in enumerate(seqs)], "run_id int, call int, tokens array<string>, n_tokens long" + ", input long, cache_read long" * bool(extra))


def test_segments_partition_the_trie(spark):
    seqs = [[1, 2, 3, 4, 5], [1, 2, 3, 9, 9], [1, 2, 3, 4, 5, 6], [7, 7, 7]]
    calls = tokens(spark, seqs)
    nodes = prefix.trie(calls)
    segs = prefix.segments(nodes).collect()
    assert sum(r["tokens"] for r in segs) == len({tuple(s[:i]) for s in seqs for i in range(1, len(s) + 1)})
    assert sum(r["tokens"] + r["reused"] for r in segs) == sum(map(len, seqs))
    matched = {r["call"]: r["matched"] for r in prefix.logical_reuse(nodes, calls).collect()}
    assert matched == {0: 0, 1: 3, 2: 5, 3: 0}


@pytest.mark.parametrize(("n", "calls", "reads", "want"), [(8, 2, [0, 3], 3), (8, 3, [0, 3, 6], 9), (6, 3, [0, 4, 2], 6)])
def test_realized_reuse(spark, n, calls, reads, want):
    c = tokens(spark, [list(range(n))] * calls, ([n] * calls, reads))
    assert rows(prefix.realized(prefix.trie(c), c))[0][1] == want


def test_block_ids_depend_on_their_parents(spark):
    c = spark.createDataFrame([(1, 0, [1, 2, 3, 4]), (1, 1, [9, 9, 3, 4]), (1, 2, [1, 2, 3])], "run_id int, call int, tokens array<int>")
    got = {(r["call"], r["position"]): r["block_id"] for r in prefix.block_references(c, 2).collect()}
    assert got[0, 1] != got[1, 1] and got[0, 0] == got[2, 0] and (2, 1) not in got


def test_cyclic_lineage_collapses():
    assert lineage.condensed_depths([("in", "a"), ("a", "b"), ("b", "a")]) == {"in": 0, "a": 1, "b": 1}
    rng = random.Random(2)
    for _ in range(30):
        nodes = list("abcdefgh")
        edges = list({(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(9)) if a != b})
        reach = {x: {x} for x in nodes}
        for _ in nodes:
            for a, b in edges:
                reach[a] |= reach[b]
        comp = {x: frozenset(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}

        def depth(c, comp=comp, edges=edges):
            ups = {comp[a] for a, b in edges if comp[b] == c and comp[a] != c}
            return max((depth(u) + 1 for u in ups), default=0)

        assert all(d == depth(comp[x]) for x, d in lineage.condensed_depths(edges).items())


def test_directory_closure(spark):
    art = spark.createDataFrame([(1, "/work/data/chr1/input.vcf"), (1, "")], "run_id int, path string")
    assert [r[1] for r in rows(metrics.directories(art))] == ["/", "/work", "/work/data", "/work/data/chr1"]


def test_shortest_unit_wins(spark):
    ev = spark.createDataFrame([(1, 42, 7, 1500.0), (1, 42, 8, 5000.0)], "run_id int, pid int, event_id int, ts_ms double")
    units = spark.createDataFrame([(1, 42, "task-1", 1000.0, 2000.0), (1, 42, "task-0", 0.0, 4000.0), (1, 43, "task-2", 1400.0, 1600.0)], "run_id int, pid int, execution_unit_id string, s double, e double")
    assert rows(attribution.annotate_units(ev, units).select("event_id", "execution_unit_id")) == [(7, "task-1"), (8, None)]


def test_attribution_priorities(spark):
    ev = spark.createDataFrame(
        [(1, 1, 5.0, "read", "/a/x", "tf", None), (1, 2, 50.0, "read", "/a", None, "tr"), (1, 3, 50.0, "read", "/a", None, None), (1, 4, 2.0, "read", "/a", None, None), (1, 5, 12.0, "read", "/w/in.txt", None, None),
         (1, 6, 12.0, "read", "/b", None, "t1"), (1, 7, 12.0, "execve", "/b", None, None), (1, 8, 12.0, "read", "/b", None, None)],
        "run_id int, event_id int, ts_ms double, syscall string, path string, fd_tool string, root_tool string")
    tools = spark.createDataFrame([(1, "t1", "CodeExec", 0.0, 20.0, None), (1, "t2", "Read", 10.0, 20.0, "./in.txt"), (1, "t3", "Bash", 9.0, 20.0, None)], "run_id int, tool_id string, tool_name string, s double, e double, file_path string")
    got = {r[0]: (r[1], r[2]) for r in rows(attribution.attribute(ev, tools, 7.0).select("event_id", "tool_id", "signal"))}
    assert got == {1: ("tf", "descriptor"), 2: ("tr", "ancestry"), 3: (None, "none"), 4: ("t1", "only_active"), 5: ("t2", "file_path"), 6: ("t1", "active_ancestry"), 7: ("t3", "only_bash"), 8: ("t2", "last_started")}


def test_descriptors_follow_forks_and_directories(spark):
    ev = [
        (1, 1, 1, "syscall", 10, "chdir", None, 0, "/w", None, "t1"), (1, 2, 2, "syscall", 10, "openat", -100, 3, "in/x", None, "t1"), (1, 3, 3, "fork", 10, None, None, None, None, 11, "t1"),
        (1, 4, 4, "syscall", 11, "read", 3, 5, None, None, None), (1, 5, 5, "syscall", 10, "close", 3, 0, None, None, None), (1, 6, 6, "syscall", 10, "read", 3, 5, None, None, None),
        (1, 7, 7, "syscall", 11, "openat", 3, 4, "y", None, None), (1, 8, 8, "syscall", 11, "openat", 9, 5, "z", None, None),
    ]
    df = spark.createDataFrame(ev, "run_id int, ts int, pos int, kind string, pid int, syscall string, fd int, ret int, path string, child_pid int, tool string")
    got = {r["pos"]: (r["path"], r["fd_tool"], r["fd_generation"], r["root_tool"]) for r in folds.resolve_descriptors(df).collect()}
    assert got[2][0] == "/w/in/x" and got[4] == ("/w/in/x", "t1", 1, "t1") and got[6][0] is None and got[7][0] == "/w/in/x/y" and got[8][0] == "z"


def test_batches_are_anchored_on_their_first_call(spark):
    calls = spark.createDataFrame([(1, "A", float(s), float(s + 10)) for s in (0, 60, 120, 180, 400)], "run_id int, tool_name string, s double, e double")
    got = folds.greedy_batches(calls)
    assert [r[1] for r in rows(got.select("s", "batch"))] == [0, 0, 1, 1, 2]
    assert {r["phase"]: r["n"] for r in folds.phases(got).collect()} == {"tool_execution": 3, "model_completion": 2}


def test_pairing_by_id_and_by_stack(spark):
    ev = [(1, i, t, k, float(x)) for i, (t, k, x) in enumerate([("start", "a", 0), ("start", None, 1), ("start", None, 2), ("end", None, 3), ("end", "a", 4), ("end", None, 5), ("end", None, 6), ("end", "b", 7)])]
    got = rows(folds.pair_segments(spark.createDataFrame(ev, "run_id int, pos int, type string, id string, t double")).select("id", "s", "e"))
    assert got == [("a", 0.0, 4.0), ("llm_1", 2.0, 3.0), ("llm_2", 1.0, 5.0)]


def test_emissions_collapse_from_the_last_kept(spark):
    c = spark.createDataFrame([(1, "k", 5, 2, i, float(e)) for i, e in enumerate((0, 80, 160, 240, 400))], "run_id int, cache_key string, input int, output int, call int, e double")
    assert [r[0] for r in rows(prefix.collapse_emissions(c).select("call"))] == [0, 2, 4]


def test_repeat_guard(spark):
    c = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabbbbc")], "run_id int, call int, cache_key string")
    assert rows(folds.repeat_guard(c, limit=3)) == [(1, 4, 3, 5)]


def test_request_sizes_and_latencies(spark):
    base = [("read", 4096, "/w/d"), ("read", 8192, "/w/d"), ("write", 200, "/w/d"), ("write", 600, "/w/d")]
    fs = spark.createDataFrame([(1, s, n, n, 0.1, float(i), p) for i, (s, n, p) in enumerate(base)], "run_id int, syscall string, requested_size long, bytes_transferred long, dur_s double, ts_ms double, path string")
    got = {r["kind"]: (r["n"], r["p50"]) for r in metrics.request_sizes(fs).collect()}
    assert got["read"] == (2, 6144.0) and got["write"] == (2, 400.0) and got["all"][0] == 4


def test_classifiers(spark):
    paths = ["/usr/lib/python3.11/site-packages/a.py", "<string>", "/w/a.so.6", "/w/__init__.py", "/w/data.csv", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(C.is_import_probe(F.col("p")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, True, True, True, False, False, False]
    flags = spark.createDataFrame([(0,), (0o2101,), (0o1000002,)], "f long").select(C.open_flags(F.col("f")).alias("x"))
    assert [r["x"] for r in flags.collect()] == ["O_RDONLY", "O_WRONLY|O_CREAT|O_APPEND", "O_RDWR|O_NOATIME"]
    size = spark.createDataFrame([(99,), (100,), (1 << 30,)], "n long").select(C.size_bin(F.col("n")).alias("x"))
    assert [r["x"] for r in size.collect()] == ["<=100B", "100B-1K", ">1G"]
    kinds = spark.createDataFrame([(x,) for x in ("/a/x.CSV", "/a/chr1.HG00096", "/a/run.tmp.1", "/a/log_1", "/a/s.lock", "/a/README", "/a/p.html", None)], "p string").select(C.file_kind(F.col("p")).alias("x"))
    assert [r["x"] for r in kinds.collect()] == ["table", "raw_data", "tmp", "log", "config", "other", "image/doc", "other"]
    noise = spark.createDataFrame([("openat", -2, "/etc/ssl/x"), ("openat", -2, "/w/x"), ("openat", 3, "/lib/x"), ("read", -2, "/lib/x")], "s string, r int, p string")
    assert [r[0] for r in noise.select(C.is_enoent_noise(F.col("s"), F.col("r"), F.col("p"))).collect()] == [True, False, False, False]
    digits = "0123456789abcdef" * 2
    tag = spark.createDataFrame([(f"[nocache:{digits}]\nhello",), ("[nocache:12]\nx",)], "t string")
    assert rows(tag.select(C.strip_nocache_tag(F.col("t")), C.nocache_tag(F.col("t")).isNull())) == [("[nocache:12]\nx", True), ("hello", False)]
    assert tag.select(C.strip_nocache_tag(C.apply_nocache_tag(F.lit("hi"), F.lit(digits)))).first()[0] == "hi"
    text = spark.createDataFrame([("Please RETRY the summary",), ("a Summary",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in text.select(C.prompt_phase(F.col("t"))).collect()] == ["backtrack", "summary", "reasoning", "reasoning"]
    assert [r[0] for r in text.select(C.code_phase(F.lit("r"), F.col("t"))).collect()] == ["action_unit_backtrack", "summary_write", "code_exec", "code_exec"]
    models = spark.createDataFrame([("p", "GPT-4o", None), (None, "qwen3.6-35b", "https://API.OpenAI.com/v1"), ("x", "m", "http://host:1/v1")], "p string, m string, u string")
    assert [r[0] for r in models.select(C.recorded_vendor(F.col("p"), F.col("m"))).collect()] == ["OpenAI", "FreeInference", "x vendor not recorded"]
    assert [r[0] for r in models.select(C.serving_vendor(F.col("p"), F.col("m"), F.lit(None).cast("string"), F.col("u"))).collect()] == ["p", "OpenAI", "host"]
    secs = spark.createDataFrame([(5.0,), (65.5,), (None,)], "s double").select(C.duration(F.col("s")), C.percent(F.col("s") / 100))
    assert rows(secs) == [("1m05.50s", "65.50%"), ("5.00s", "5.00%"), ("n/a", "n/a")]


@pytest.mark.parametrize(("text", "want"), [
    ("import pandas as pd\npd.read_csv('a.csv')", ["stdio"]), ("import pandas as pd\npd.read_parquet('a')", ["structured"]), ("import h5py\nf = h5py.File('x')\nf.create_dataset('d')", ["structured"]),
    ("import os\nfd = os.open('f', 0)\nos.read(fd, 1)", ["posix_raw"]), ("import subprocess\nsubprocess.run(['cat', 'f'])", ["posix_raw"]), ("import os\nos.system('grep foo b > c')", ["posix_raw"]),
    ("import json\nwith open('f') as h:\n    json.load(h)", ["stdio"]), ("from mpi4py import MPI\nMPI.File.Open(MPI.COMM_WORLD, 'd')", ["mpiio"]), ("import faiss\nfaiss.read_index('i')", ["vector_index"]),
    ("import pandas as pd\npd.read_csv('a')\nimport h5py\nh5py.File('b')", ["stdio", "structured"]), ("x = 1 + 2\nprint(x)", []), ("def broken(:\n  pd.read_csv('a')", ["stdio"]), ("load_all(1)", ["stdio", "posix_raw"]),
])
def test_code_layers(text, want):
    assert code.code_layers(text, {"load_all": ["posix_raw", "stdio"]})[0] == want


def test_sections_partition_the_prompt(spark):
    user = "You are an analyst.\n**General Guidelines**: be careful\n**Task History**\nold\n[Code]:\nx = 1\n[Output]:\n42\nOutput Paths: /o"
    msgs = [{"role": "system", "content": "S"}, {"role": "user", "content": user}, {"role": "assistant", "content": "A"}]
    df = spark.createDataFrame([(1, 1, msgs), (1, 2, []), (1, 3, [{"role": None, "content": None}, {"role": "user", "content": "no header"}])], "run_id int, call int, messages array<struct<role:string,content:string>>")
    sections = prompts.prompt_sections(df, headers=True)
    got = [tuple(r)[2:] for r in sections.filter("call = 1").orderBy("start").collect()]
    assert [tuple(r)[2:] for r in sections.filter("call = 3").orderBy("start").collect()] == [(0, 7, "<?>", "instructions"), (7, 26, "<user>", "unlabeled")]
    text = "".join(f"<|{m['role']}|>\n{m['content']}\n" for m in msgs)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert [g[3] for g in got] == ["system message", "instructions", "instructions", "history dialog", "code", "raw data", "instructions", "history dialog"]
    assert [g[2] for g in got] == ["<system>", "preamble", "General Guidelines", "Task History", "Code", "Output", "Output Paths", "<assistant>"]
    for start, _, name, _ in got[2:7]:
        assert text[start:].lstrip("[*").startswith(name)
    assert prompts.uses_headers(df, least=1.5) and not prompts.uses_headers(df, least=99)
    plain = prompts.prompt_sections(df, headers=False).filter("call = 1").orderBy("start").collect()
    assert [r["tag"] for r in plain] == ["system message", "document text", "history dialog"]
    tags = spark.createDataFrame([(1, 1, 0, "b", 5), (1, 1, 0, "a", 5), (1, 1, 0, "c", 2)], "run_id int, call int, seg int, tag string, tokens long")
    assert rows(prompts.widest_tag(tags)) == [(1, 1, 0, "a", 5)]


def test_replay_tables(spark):
    arms = spark.createDataFrame([("b", "x", 1, 1000.0, 1.0, 1.0, '{"block_size":"16","m":"q"}'), ("b", "y", 2, 1500.0, 1.0, 1.0, '{"block_size":"1568","m":"q"}')], "bundle string, arm string, recorded int, ttft_ms double, tpot_ms double, total_ms double, config string")
    assert {r["arm"]: r["ttft_ms_pct"] for r in replay.against_baseline(arms).collect()} == {"x": 0.0, "y": 50.0}
    assert [r["key"] for r in replay.differing_config(arms).collect()] == ["block_size"]
    reps = spark.createDataFrame([("x", "rep1", 0.3888), ("x", "rep2", 0.9935), ("y", "rep1", 0.5)], "arm string, rep string, hit_rate double")
    assert [r["arm"] for r in replay.warming_arms(reps).collect()] == ["x"]
    states = spark.createDataFrame([(0, 0, False), (122473, 37632, False), (5, 5, True)], "queries long, hits long, reset boolean").select(replay.cache_state())
    assert [r[0] for r in states.collect()] == ["cold_since_restart", "warm_inherited", "cold_by_reset"]
    a = spark.createDataFrame([(1, 10, 5), (2, 10, 5)], "k int, queries long, hits long")
    b = spark.createDataFrame([(1, 30, 10), (2, 10, 5)], "k int, queries long, hits long")
    assert rows(replay.prefix_cache_delta(a, b, ["k"])) == [(1, 20, 5, 0.25), (2, 0, 0, None)]
    with pytest.raises(Exception, match="too few rows"):
        replay.first_n(a, "k", "queries", 2).collect()


def test_spearman_with_ties_and_without_variance(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 30), (2, 5, 1), (2, 5, 2)], "run_id int, x int, y int")
    assert rows(concurrency.spearman(df, "x", "y")) == [(1, 3, pytest.approx(0.866025)), (2, 2, None)]


def test_failure_is_the_presence_of_a_key(spark):
    ev = spark.createDataFrame([(1, "message_end", True), (1, "message_end", False), (1, "message_start", True)], "run_id int, type string, has_error_key boolean")
    assert rows(quality.llm_health(ev)) == [(1, 2, 1, 0.5, False)]


def test_empty_inputs(spark):
    fs = spark.createDataFrame([], "run_id int, event_id long, pid int, tid int, ts_ms double, dur_s double, syscall string, path string, bytes_transferred long, requested_size long, return_value long, fd int, open_generation int, offset long, append boolean, resource_bucket string, tool_call string, phase string, role string")
    for f in (metrics.bytes_ops_by_phase, metrics.sequentiality, metrics.mergeability, metrics.bursts, metrics.inter_arrival, lineage.artifacts, lineage.write_read_gaps, metrics.effective_bandwidth):
        assert f(fs).count() == 0


def test_report_edge(spark, tmp_path):
    from wakeline.plans import report

    ev = spark.createDataFrame([(1, "t", None, "tool", 0.0, 9.0), (1, "a", "t", "llm", 1.0, 3.0), (1, "b", "t", "llm", 4.0, 8.0)], "run_id int, id string, parent string, kind string, s double, e double")
    assert report.call_tree(ev, 1).splitlines() == ["t [tool] 0.009 s", "  a [llm] 0.002 s", "  b [llm] 0.004 s"]
    dot = report.call_dot(ev, concurrency.sequence_edges(ev), 1)
    assert '"t" -> "a";' in dot and '"a" -> "b" [style=dashed];' in dot
    assert rows(concurrency.max_leaf_width(ev)) == [(1, 1)]
    assert "| run_id |" in report.markdown(ev.select("run_id").limit(1))
    report.write(ev, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    times = report.run_stages(spark, [("b", ["a"], lambda d: d["a"].filter("id > 0")), ("a", [], lambda d: spark.range(3))], str(tmp_path / "stages"))
    assert [r["stage"] for r in times.collect()] == ["a", "b"] and spark.read.parquet(str(tmp_path / "stages/b")).count() == 2
    with pytest.raises(ValueError, match="wait for each other"):
        report.run_stages(spark, [("a", ["a"], lambda d: d["a"])], str(tmp_path / "x"))
    assert report.path_config(None, [], ["/m"], ["/d"]) == ["/m"] and report.path_config(["/e"], ["/s"], None, []) == ["/e"]
    seen = spark.createDataFrame([(0, 5), (None, 5), (None, None)], "r int, c int").select(report.cached_tokens(F.col("r"), F.col("c")).alias("x")).collect()
    assert [tuple(r["x"]) for r in seen] == [(0, True, "response"), (5, True, "counter"), (None, False, None)]
    hit = spark.createDataFrame([(10, 4, 10), (12, 4, 10)], "q int, h int, p int").select(report.cache_hit(F.col("q"), F.col("h"), F.col("p")))
    assert [r[0] for r in hit.collect()] == [4, None]
    one = spark.createDataFrame([(1, "x", "r", None, None)], "run_id int, id string, role string, phase string, io_layers array<string>")
    two = spark.createDataFrame([(1, "x", None, "p", ["stdio"])], "run_id int, id string, role string, phase string, io_layers array<string>")
    assert rows(report.code_index(one, one, two)) == [(1, "x", "r", "p", ["stdio"])]


def test_overlap_of_two(spark):
    df = spark.createDataFrame([(0.0, 5.0, 3.0, 9.0), (0.0, 1.0, 1.0, 2.0), (0.0, 1.0, 4.0, 5.0), (0.0, 9.0, 2.0, 3.0), (None, 1.0, 0.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(I.overlap(*map(F.col, "abcd"))).collect()] == [2.0, 0.0, 0.0, 1.0, None]


def test_token_residual(spark):
    ddl = "run_id int, counted long, recorded long"
    df = spark.createDataFrame([(1, 90, 100), (1, 50, 50), (1, None, 1000), (2, 5, None), (2, 0, 0), (3, None, 7)], ddl)
    assert rows(concurrency.token_residual(df).na.fill(-1.0, ["residual_pct"])) == [(1, 3, 2, 1, 6.666667), (2, 2, 2, 0, -1.0), (3, 1, 0, 0, -1.0)]
    assert rows(concurrency.token_residual(spark.createDataFrame([], ddl))) == []


def test_usage_by_parent(spark):
    ddl = "run_id int, parent string, input long, output long, cache_read long"
    df = spark.createDataFrame([(1, "a", 5, 1, 0), (1, "a", 7, None, 2), (1, None, 1, 1, None)], ddl)
    assert rows(concurrency.usage_by_parent(df)) == [(1, "(root)", 1, 1, 1, 0), (1, "a", 2, 12, 1, 2)]
    assert rows(concurrency.usage_by_parent(spark.createDataFrame([], ddl))) == []


def test_reuse_ages(spark):
    calls = spark.createDataFrame(
        [(1, 0, 0.0, 1000.0, 10, 0), (1, 1, 500.0, 2000.0, 10, 9), (1, 2, 5000.0, 6000.0, 10, 8), (1, 3, 9000.0, 9500.0, 10, 7), (2, 0, 0.0, 1.0, 0, 0)],
        "run_id int, call int, s double, e double, input long, cache_read long",
    )
    # call 1 began before its only candidate ended; call 2 has one that had ended, call 3 two of them
    cand = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 0, 4), (1, 3, 1, 6), (1, 3, 2, 6)], "run_id int, call int, source int, lcp int")
    assert rows(prefix.reuse_ages(cand, calls).na.fill(-1.0)) == [(1, 2, 4.0, 4.0), (2, 0, -1.0, -1.0)]


def test_sweep_arms(spark):
    ddl = "sweep string, arm string, rep string, source string, bundle string, cache_state string, recorded long, hit_rate double, ttft_ms double, tpot_ms double, total_ms double"
    of = "/x/results/old/c/results/run_20240203_040506/cell7"
    df = spark.createDataFrame([
        ("s", "a", "rep1", of, "b.json", "warm", 9, 0.5, 10.0, 1.0, 1.0), ("s", "a", "rep2", None, None, "cold", 1, None, 20.0, 1.0, 1.0),
        ("s", "b", "rep1", of, "b.json", None, 5, None, None, 1.0, 1.0), ("t", "a", "rep1", "results/odd", "/p/q.json", "cold", None, 1.0, 1.0, 1.0, 1.0), ("t", "b", "rep1", None, None, "cold", 3, 1.0, 1.0, 1.0, 1.0),
    ], ddl)
    got = {(r["sweep"], r["arm"]): r for r in replay.sweep_arms(df).collect()}
    a = got["s", "a"]
    assert (a["case"], a["stamp"], a["reps"], a["cache_states"], a["hit_rate"], a["ttft_ms"], a["recorded"], a["position"]) == ("cell7 \u00b7 02-03 04:05", "20240203_040506", 2, "cold,warm", 0.5, 15.0, 9, 2)
    assert (got["s", "b"]["position"], got["s", "b"]["hit_rate"], got["s", "b"]["cache_states"]) == (1, None, "")
    assert [(got["t", x]["case"], got["t", x]["stamp"], got["t", x]["position"]) for x in "ab"] == [("q", "", 1), ("unknown source", "", 2)]
    assert rows(replay.sweep_arms(spark.createDataFrame([], ddl))) == []


def test_widest_span(spark):
    seg = spark.createDataFrame([(1, 1, 0, 3, 20), (1, 1, 1, 20, 20)], "run_id int, call int, seg int, a int, z int")
    parts = spark.createDataFrame([(1, 1, "x", "p", 0, 6), (1, 1, "y", "q", 6, 9), (1, 1, "x", "r", 9, 12), (1, 1, "y", "s", 12, 40)], "run_id int, call int, tag string, name string, t0 int, t1 int")
    assert rows(prompts.widest_span(seg, parts)) == [(1, 1, 0, "x", 3, 6, "p"), (1, 1, 0, "y", 12, 20, "s")]
