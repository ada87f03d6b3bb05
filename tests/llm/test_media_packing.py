"""Audio columns and packing."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from wakeline.llm import media, packing

# ---- media


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 1006, 1007, 5000, 200_000])
def test_round_trip(size):
    raw = bytes(random.Random(size).randrange(256) for _ in range(size))
    payload = media.payload_of(raw)
    assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and len(payload) > 0
    stored = media.pack_payload(payload)
    x = media.index_audio(stored)
    assert media.unpack_payload(stored, x) == payload
    assert x["crc_failed"] == 0 and x["skipped"] == 0 and not x["truncated"] and x["audio_end"] == len(stored)
    assert x["table"]["frames"] == len(x["seek"]) and x["samples"] == 1152 * len(x["seek"]) and x["table"]["bytes"] == len(stored) - x["audio_start"]


MARKS = [b"TAG", b"APETAGEX", b"ID3\4\0\0\0\0\0\x20", b"Xing", b"Info", b"VBRI", b"LAME", b"\xff\xfb\xe4\x00", b"\xff\xfb", b"\xff"]


@pytest.mark.parametrize("mark", MARKS)
def test_payloads_that_look_like_audio(mark):
    for size in (64, 128, 192, 960, 1024, 1984, 2048):
        for at in [*range(0, min(size, 70)), *range(max(0, size - 200), size - len(mark) + 1)]:
            payload = (b"a" * at + mark + b"b" * size)[:size]
            stored = media.pack_payload(payload)
            x = media.index_audio(stored)
            assert media.unpack_payload(stored, x) == payload and x["skipped"] == 0, (size, at)
        payload = (mark * size)[:size]
        assert media.unpack_payload(media.pack_payload(payload)) == payload
    tagged = media.pack_payload(b"x" * 64) + b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    x = media.index_audio(tagged)
    assert x["tags"]["title"] == "title" and media.unpack_payload(tagged, x) == b"x" * 64


def test_damage_is_found_and_frames_are_found_again():
    payload = bytes(range(1, 65)) * 400
    stored = media.pack_payload(payload)
    whole = media.index_audio(stored)
    n = len(whole["seek"])
    cut = whole["seek"][5]
    broken = bytearray(stored)
    broken[cut + 10] ^= 1  # side information
    assert media.index_audio(bytes(broken))["crc_failed"] == 1
    noisy = stored[:cut] + b"\xff\xfb\x00noise\xff\xe0" + stored[cut:]
    x = media.index_audio(noisy)
    assert len(x["seek"]) == n and x["skipped"] == 10 and x["resyncs"] == 1 and x["seek"][5] == cut + 10
    x = media.index_audio(stored[:-7])
    assert x["truncated"] and len(x["seek"]) == n - 1
    x = media.index_audio(b"garbage" + stored[whole["audio_start"] :])
    assert len(x["seek"]) == n and x["skipped"] == 7


def test_other_tags_and_tables():
    head, room = media._HEADS[9]
    frame = head + bytes(room)
    vbri = bytearray(frame)
    vbri[36:40], vbri[46:54] = b"VBRI", struct.pack(">II", 4 * len(frame), 3)
    v1 = b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    x = media.index_audio(bytes(vbri) + frame * 3 + v1)
    assert x["table"] == {"table": "VBRI", "bytes": 4 * len(frame), "frames": 3, "at": 0} and x["tags"] == {"title": "title"} and len(x["seek"]) == 3
    assert media.index_audio(frame * 4)["samples"] == 4608
    for odd in (None, b"", b"\xff", b"no audio here", bytes(1000), b"\xff" * 500, b"ID3\4\0\0\x7f\x7f\x7f\x7f"):
        assert media.index_audio(odd)["seek"] == []
    # layer and version tables: 128 kbit/s at 44.1 kHz is 417 bytes, MPEG-2 64 kbit/s at 22.05 kHz is 208
    assert media.header(0xFFFB9000)["size"] == 417 and media.header(0xFFFB9200)["size"] == 418 and media.header(0xFFF38000)["size"] == 208 and media.header(0xFFFF1000)["layer"] == 1


def test_columns(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (5, "é" * 70_000), (6, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("media", "kind", "_text", "_media")})
    got = {r["doc_id"]: r for r in media.read_media(media.store_texts(docs), payload=True).collect()}
    for d, t in rows:
        p = media.payload_of((t or "").encode())
        assert (got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert got[d]["crc_failed"] == 0 and got[d]["duration_s"] == got[d]["samples"] / 44100
    assert got[1]["media_sha256"] == got[4]["media_sha256"] and got[1]["feature"] == got[4]["feature"] and got[2]["media_sha256"] == got[3]["media_sha256"]
    foreign = media.read_media(spark.createDataFrame([(1, b"abc"), (2, None)], "id int, media binary"), payload=True).collect()
    assert all(r["n_frames"] == 0 and r["kind"] is None and r["payload_bytes"] == 0 for r in foreign)
    assert media.read_media(media.store_texts(docs.limit(0)), payload=True).count() == 0


# ---- packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 4)
        got = packing.boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best
    assert packing.boundaries(np.array([]), np.array([]), 3) == []


def test_both_ways_find_the_same_boundaries(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (2, 3, 7, 200, 900):
        for _ in range(5):
            lengths, counts = np.sort(rng.choice(10 * n, n, replace=False)), rng.integers(1, 1 + rng.integers(1, 30), n)
            monkeypatch.setattr(packing, "MAX_LENGTHS", n)
            whole = packing.boundaries(lengths, counts, 6)
            monkeypatch.setattr(packing, "MAX_LENGTHS", 0)
            assert packing.boundaries(lengths, counts, 6) == whole
    assert len(packing.boundaries(np.arange(300_000), np.ones(300_000, np.int64), 16)) == 16


def test_one_long_document_moves_no_other_boundary(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_LENGTHS", 20)
    sizes = [*range(10, 60), 50_000]
    got = packing.pack(spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string"), buckets=4).collect()
    best = min(padding(sizes, [1] * len(sizes), [*c, sizes[-2], sizes[-1]]) for c in itertools.combinations(sizes[:-2], 2))
    assert sum(r["padding"] for r in got) == best


@pytest.mark.parametrize("most", [6000, 5])
def test_batches(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "MAX_LENGTHS", most)
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    monkeypatch.setattr(packing, "CROWDED", 2)
    rng = random.Random(most)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1, rows[1][1]), (None, "a b"), (400, None), (401, ""), (402, "word " * 3000)]
    rows += [(None, None)] * 150 + [(7, "five words of one text")] * 150  # of each, a block of its own is divided
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(1)).repartition(6), buckets=4, token_budget=200).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == sorted((d, len((t or "").split())) for d, t in rows if d is not None)
    assert len({r["bucket_len"] for r in got}) <= 4 and all(r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in got)
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r)
    short = {}
    for b in batches.values():
        size, room = b[0]["bucket_len"], max(1, 200 // max(1, b[0]["bucket_len"]))
        assert sorted(r["slot"] for r in b) == list(range(len(b))) and len(b) <= room and {r["batch_rows"] for r in b} == {len(b)}
        short[size] = short.get(size, 0) + (len(b) < room)
    assert max(short.values()) <= 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
