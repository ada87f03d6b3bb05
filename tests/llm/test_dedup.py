"""Line dedup, suffix dedup and the Jaccard join against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F
from wakeline.llm import components, jaccard_join, line_dedup, suffix_dedup


def make(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("n_lines", "g", "_t", "_h", "_d", "_id", "_n", "_c", "n", "cid", "hash", "count")
    return df.withColumns({c: F.lit("x") for c in clash}).repartition(3) if extra else df


# ---- lines


def lines_by_hand(rows, min_docs, min_chars):
    docs = {}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(d)
    hot = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in hot or d == hot[key(x)]]
        docs[d, t] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return docs


@pytest.mark.parametrize("heavy", [1, 2000])
def test_lines(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(1)
    common = ["Accept ALL cookies\t", "  accept all cookies", "Éa shared line", "short", ""]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"line {rng.randrange(400)} of text" for _ in range(rng.randint(0, 7)))) for i in range(60)]
    rows += [(3, rows[3][1]), (4, "another text\naccept all cookies"), (None, "accept all cookies\nx"), (70, None), (71, ""), (72, "y " * 90_000 + "\naccept all cookies")]
    got = line_dedup.dedup_lines(make(spark, rows), 5, 8).collect()
    want = lines_by_hand(rows, 5, 8)
    assert len(got) == len(rows)
    assert all((r["n_lines"], r["n_dropped"], r["kept_text"]) == want[r["doc_id"], r["text"]] for r in got)
    assert sum(r["n_dropped"] for r in got) > 50
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


# ---- suffixes


def bytes_by_hand(rows, length):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[d] = bytes(x for x, k in zip(b, gone) if not k)
    return out


@pytest.mark.parametrize(("length", "gram", "crowd"), [(20, 8, 20_000), (20, 8, 1), (100, 32, 20_000)])
def test_repeated_bytes(spark, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 2000)
    rng = random.Random(length)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(10, 3 * length))) for _ in range(10)]
    rows = []
    for i in range(80):
        s = "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 2 * length))) for _ in range(rng.randint(0, 7)))
        if s and rng.random() < 0.3:
            k = rng.randrange(len(s))
            s = s[:k] + "X" + s[k + 1 :]
        rows.append((i, s + s if rng.random() < 0.2 else s))
    rows += [(200, "a" * 500), (201, "ab" * 300), (5, rows[5][1]), (300, None), (None, pool[0] * 2), (301, "word " * 30_000)]
    got = suffix_dedup.remove_repeats(make(spark, rows).withColumn("kept", F.lit(0)), length, gram).collect()
    want = bytes_by_hand(rows, length)
    assert len(got) == len(rows)
    for r in got:
        raw = (r["text"] or "").encode()
        assert bytes(r["kept"]) == want[r["doc_id"]] and r["n_bytes"] == len(raw) and r["n_removed"] == len(raw) - len(r["kept"])
        assert b"".join(raw[a:z] for (_, a), (z, _) in zip([(0, 0), *r["removed"]], [*r["removed"], (len(raw), 0)])) == bytes(r["kept"])
        assert all(x[1] < y[0] for x, y in zip(r["removed"], r["removed"][1:]))


def test_suffix_array_and_maximal_repeats():
    rng = random.Random(7)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(6)]
        s = suffix_dedup.SuffixArray(texts, 3)
        flat = b"".join(texts)
        suffix = lambda p: flat[p : s.begin[s.owner[p] + 1]]  # noqa: B023, E731
        order = [suffix(p) for p in s.sa]
        assert all(a[:16] <= b[:16] for a, b in zip(order, order[1:]))
        got = {(n, flat[p[0] : p[0] + n]): sorted(p.tolist()) for n, p in suffix_dedup.maximal_repeats(s, 3)}
        spots = {}
        for p in s.sa.tolist():
            for n in range(3, len(suffix(p)) + 1):
                spots.setdefault(suffix(p)[:n], []).append(p)

        def ends(p, n, texts=texts, s=s, flat=flat):
            left = None if p == s.begin[s.owner[p]] else flat[p - 1]
            right = None if p + n == s.begin[s.owner[p] + 1] else flat[p + n]
            return left, right

        for w, at in spots.items():
            if len(at) > 1:
                e = [ends(p, len(w)) for p in at]
                diverse = lambda xs: len(set(xs)) > 1 or xs.count(None) > 1
                assert ((len(w), w) in got) == (diverse([x for x, _ in e]) and diverse([y for _, y in e])), w
                if (len(w), w) in got:
                    assert got[len(w), w] == sorted(at)


def test_suffix_empty(spark):
    assert suffix_dedup.remove_repeats(make(spark, [])).count() == 0


# ---- sets


def components_by_hand(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if sets[i] and sets[j] and (same or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [500_000, 40])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard_join, "BLOCK", part)
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 300)
    if part == 40:  # the ways taken beyond the sizes that one task or a broadcast may have
        monkeypatch.setattr(jaccard_join, "HUB", 2)
        monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(components, "TASK_EDGES", 3)
    rng = random.Random(part)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.3:
                w += passage
            rows.append((len(rows) * 7 % 101, " ".join(x.upper() if rng.random() < 0.3 else x for x in w)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE\ttwo"), (505, "one two three"), (rows[0][0], rows[0][1]), (rows[3][0], "x y z u v w"), (900, "X y z u v w"), (None, rows[5][1]), (None, "q q q"), (506, "a " * 40_000)]
    got = jaccard_join.jaccard_components(make(spark, rows)).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == components_by_hand(rows, 5, 75)
    kept = jaccard_join.drop_near_duplicates(make(spark, rows)).collect()
    stay = [r["doc_id"] for r in kept if (r["text"] or "").strip(" \t\n")]
    assert sorted(stay, key=repr) == sorted([*{r[2] for r in got if r[1] and r[0] is not None and r[0] == r[2]}, None, None], key=repr)
    assert sum(1 for r in kept if not (r["text"] or "").strip(" \t\n")) == 3


@pytest.mark.parametrize("most", [2_000_000, 5])
def test_connected(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(most)
    edges = [(i, i + 1) for i in range(40)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(7, 7), (3, 2), (None, 5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for e in edges if None not in e and e[0] != e[1] for x in e}


def test_no_rows(spark):
    assert jaccard_join.jaccard_components(make(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(make(spark, [(1, "a b c d e f g")])).collect()[0][:3] == (1, 3, 1)
