"""Readers on small trace directories, and the streaming forms."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from wakeline.sources import traces
from wakeline.streaming import live


@pytest.fixture
def cell(tmp_path):
    d = tmp_path / "runs" / "r1" / "c1"
    d.mkdir(parents=True)
    return d


def lines(path, items):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in items))


def test_events_come_in_time_order_and_late_ones_fail(spark, cell):
    ev = [{"type": "meta", "wall_start_ns": 5}, *({"type": "syscall", "ts_ns": t * 10**6, "pid": 1, "syscall": "read"} for t in (300, 100, 350)), "{broken"]
    lines(cell / "ebpf_events.log", ev)
    got = traces.read_events(spark, str(cell / "ebpf_events.log")).orderBy("seq").collect()
    assert [r["ts_ns"] // 10**6 for r in got] == [100, 300, 350] and (got[0]["run"], got[0]["cell"]) == ("r1", "c1")
    assert traces.read_event_meta(spark, str(cell / "ebpf_events.log")).first()["wall_start_ns"] == 5
    with pytest.raises(Exception, match="reorder window"):
        traces.read_events(spark, str(cell / "ebpf_events.log"), 10**8).collect()


def test_raw_events_become_facts(spark, cell):
    lines(cell / "e.log", [{"type": "syscall", "ts_ns": 2 * 10**9, "pid": 1, "tid": 1, "syscall": "read", "ret": 10, "latency_ns": 10**6, "arg0": 3, "arg2": 4096}, {"type": "syscall", "ts_ns": 3 * 10**9, "pid": 1, "syscall": "openat", "ret": -2, "arg0": 2**64 - 100, "arg2": 577, "path": "/x"}])
    got = traces.to_fs_entries(traces.read_events(spark, str(cell / "e.log"))).orderBy("ts_ms").collect()
    assert (got[0]["bytes_transferred"], got[0]["requested_size"], got[0]["fd"], got[0]["dur_s"]) == (10, 4096, 3, 0.001)
    assert (got[1]["fd"], got[1]["errno"], got[1]["open_flags"]) == (-100, 2, "O_WRONLY|O_CREAT|O_TRUNC")


def test_tool_log(spark, cell):
    lines(cell / "tool_calls.log", ["[10:00:00.5 -> 10:00:01.25] (750ms) Read (id=t1) input={'file_path': 'a', 'n': None}", "[23:59:59 -> 00:00:01] Bash (id=t2) input=not a literal(", "[10:00:00] Task (id=t3) input={}", "noise"])
    got = {r["tool_id"]: r for r in traces.read_tool_log(spark, str(cell / "tool_calls.log"), "2024-01-01").collect()}
    assert set(got) == {"t1", "t2"} and got["t1"]["e"] - got["t1"]["s"] == 750.0 and got["t2"]["e"] - got["t2"]["s"] == 2000.0
    assert json.loads(got["t1"]["input"]) == {"file_path": "a", "n": None} and "raw" in json.loads(got["t2"]["input"])
    assert traces.read_tool_log(spark, str(cell / "tool_calls.log"), "2024-01-01", drop_task=False).count() == 3


def test_llm_calls_drop_failures_and_take_the_last_event(spark, cell):
    use = {"input": 10, "output": 3, "cacheRead": 4}
    lines(cell / "pi_events.jsonl", [
        {"type": "message_start", "run_id": "a", "message": {"timestamp": 1.0}}, {"type": "message_start", "run_id": "a", "message": {"timestamp": 2.0}}, {"type": "message_end", "run_id": "a", "message": {"timestamp": 9.0, "usage": use}, "agent_role": "x"},
        {"type": "message_end", "run_id": "b", "error": "boom", "message": {"timestamp": 9.0}}, {"type": "message_end", "run_id": "c", "error": "", "message": {"timestamp": 9.0, "usage": use}}, "oops",
    ])
    lines(cell / "messages.jsonl", [{"run_id": r, "messages": [{"role": "user", "content": "hi"}]} for r in "ab"])
    ev = traces.read_agent_events(spark, str(cell / "pi_events.jsonl"))
    calls = traces.llm_calls(ev, traces.read_messages(spark, str(cell / "messages.jsonl"))).collect()
    assert [(r["run_id"], r["s"], r["e"], r["cache_read"], r["prompt"]) for r in calls] == [("a", 2.0, 9.0, 4, "<|user|>\nhi\n")]
    assert ev.filter("has_error_key").count() == 2
    assert {r["run_id"]: r["role"] for r in traces.phase_index(ev).collect()}["a"] == "x"


def test_prometheus(spark, cell):
    (cell / "after.txt").write_text('# HELP x\nvllm:prefix_cache_queries_total{engine="0"} 100\nvllm:prefix_cache_hits_total{engine="0"} 25\nvllm:cache_config_info{block_size="16",x="a b"} 1.0\n')
    m = traces.read_prometheus(spark, str(cell / "after.txt"))
    assert traces.prefix_cache_counters(m).select("queries", "hits").collect() == [(100, 25)]
    assert {(r["key"], r["value"]) for r in traces.cache_config(m).collect()} == {("block_size", "16"), ("x", "a b")}


def test_other_sources(spark, cell):
    lines(cell / "execution_units.jsonl", [{"execution_unit_id": "u", "pid": 1, "start_ts_ms": 1.0, "end_ts_ms": 2.0}, {"execution_unit_id": ""}])
    assert traces.read_execution_units(spark, str(cell / "execution_units.jsonl")).count() == 1
    (cell / "manifest.json").write_text('{"run_id": "r",\n "workflow": "w"}')
    assert traces.read_manifest(spark, str(cell / "manifest.json")).first()["workflow"] == "w"
    assert traces.discover_cells(spark, str(cell.parent.parent)).select("run", "cell").collect() == [("r1", "c1")]
    (cell / "parsed.json").write_text(json.dumps({"fs_entries": [{"syscall": "read", "pid": 1}, {"syscall": "write"}]}))
    assert traces.read_fs_entries(spark, str(cell / "parsed.json")).count() == 2
    (cell / "server_tokens.json").write_text(json.dumps({"a": {"tokens": [1, 2], "token_strs": ["Ġhi", "Ã©"]}}))
    assert traces.bytes_of_surface(traces.read_server_tokens(spark, str(cell / "server_tokens.json"))).first()["text"] == " hié"
    assert traces.read_file_sizes(spark, str(cell)).count() >= 3


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streaming_bins(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, datetime(2024, 1, 1, 0, 0, s), 10) for s in (1, 30, 59)] + [(1, datetime(2024, 1, 1, 0, m, 0), 5) for m in (1, 9)]
    spark.createDataFrame(rows, "run_id int, ts timestamp, bytes long").coalesce(1).write.json(str(src))
    ev = live.read_events(spark, str(src), spark.createDataFrame([], "run_id int, ts timestamp, bytes long").schema)
    got = {r["start"].minute: r["bytes"] for r in drain(live.binned_bytes(ev), "bins")}
    assert got[0] == 30 and got[1] == 5


def test_streaming_plans_are_valid(spark, tmp_path):
    (tmp_path / "s").mkdir()
    schema = spark.createDataFrame([], "run_id int, ts timestamp, bytes long, call long, cache_key string, ts_ns long, metric string, number double").schema
    ev = live.read_events(spark, str(tmp_path / "s"), schema)
    assert live.bursts(ev).isStreaming and live.counter_deltas(ev).isStreaming
    starts = ev.select("run_id", F.col("call").alias("id"), F.col("ts").alias("s"))
    ends = ev.select("run_id", F.col("call").alias("id"), F.col("ts").alias("e"))
    assert live.pair(starts, ends).isStreaming
    assert live.mark_late(ev).columns == ["run_id", "ts_ns", "late"] and live.repeat_guard(ev).columns == ["run_id", "call", "repeats"]
