"""Cross-entropy difference scores against a direct computation."""

import math
from collections import Counter

import pytest
from wakeline.llm import lm_scoring
from wakeline.llm.base import most_frequent

DOCS = [
    (1, "the cat sat on the mat"), (2, "the cat sat on the rug the cat"), (3, "a dog ran to the cat"),
    (4, None), (5, "  "), (6, "dog dog dog"), (6, "dog dog dog"), (None, "the mat"), (8, "the dog sat"),
]


def direct(docs, target, weight=0.7):
    words = [(d, (t or "").lower().split()) for d, t in docs]
    vocab = lm_scoring.VOCABULARY
    models = []
    for own in (False, True):
        uni, hist, bi = Counter(), Counter(), Counter()
        for d, w in words:
            if (d in target) == own:
                uni.update(w)
                for v, x in zip(["<s>", *w], w):
                    hist[v] += 1
                    bi[v, x] += 1
        models.append((uni, hist, bi, sum(uni.values())))
    out = []
    for d, w in words:
        pairs = Counter(zip(["<s>", *w], w))
        loss = []
        for own, (uni, hist, bi, n) in zip((False, True), models):
            total = 0.0
            for (v, x), c in pairs.items():
                less = c if (d in target) == own else 0
                p1 = (uni[x] + 1) / (n + vocab)
                seen = hist[v] - less
                total -= c * math.log(weight * (bi[v, x] - less) / seen + (1 - weight) * p1 if seen > 0 else p1)
            loss.append(total / len(w) if w else None)
        out.append((d, len(w), *loss))
    return out


@pytest.mark.parametrize("hot", [lm_scoring.HOT, 3, 0])
def test_scores_equal_the_direct_computation(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "FRAGMENT", 7)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(1,), (6,), (6,), (None,), (99,)], "doc_id long")
    got = sorted(map(tuple, lm_scoring.score(docs, target).collect()), key=repr)
    want = sorted(direct(DOCS, {1, 6}), key=repr)
    assert len(got) == len(want)
    for g, (d, n, background, own) in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1]))):
        assert (g[0], g[1]) == (d, n)
        if n:
            assert g[2] == pytest.approx(own, abs=1e-8) and g[3] == pytest.approx(background, abs=1e-8)
            assert g[4] == pytest.approx(own - background, abs=1e-8)
        else:
            assert g[2:] == (None, None, None)


def compare(got, want):
    by = lambda r: (str(r[0]), r[1])
    assert len(got) == len(want)
    for g, (d, n, background, own) in zip(sorted(map(tuple, got), key=by), sorted(want, key=by)):
        assert (g[0], g[1]) == (d, n)
        assert g[2:4] == ((pytest.approx(own, abs=1e-8), pytest.approx(background, abs=1e-8)) if n else (None, None))


@pytest.mark.parametrize("numbered", [0, 1, 3])
def test_words_without_a_number_have_counts_of_their_own(spark, monkeypatch, numbered):
    monkeypatch.setattr(lm_scoring, "NUMBERED", numbered)
    monkeypatch.setattr(lm_scoring, "FRAGMENT", 7)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(1,), (6,)], "doc_id long")
    compare(lm_scoring.score(docs, target).collect(), direct(DOCS, {1, 6}))


def test_more_words_than_numbers(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 160 + j) % 80_000}" for j in range(200)) + " the end of the text") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.score(docs, spark.range(0, 500, 3).withColumnRenamed("id", "doc_id")).collect()
    words = len({w for _, t in rows for w in t.split()})
    assert words > lm_scoring.VOCABULARY
    monkeypatch.setattr(lm_scoring, "VOCABULARY", words)
    compare(got, direct(rows, set(range(0, 500, 3))))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ids = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.score(docs, ids).count() == 0


def test_most_frequent_keeps_to_its_bound(spark):
    counts = spark.range(1, 1001).selectExpr("id AS w", "id AS c")
    kept = most_frequent(counts, "c", 100, "w")
    rows = [r["c"] for r in kept.collect()]
    assert sorted(rows) == list(range(901, 1001))


def test_the_step_at_the_limit_fills_it(spark):
    counts = spark.range(0, 100_000).selectExpr("id AS w", "CASE WHEN id < 10 THEN 100 ELSE 1 END AS c")
    kept = most_frequent(counts, "c", 50_000, "w")
    assert kept.count() == 50_000 and kept.filter("w < 50000").count() == 50_000 and most_frequent(counts, "c", 100_000, "w").count() == 100_000


def test_equal_counts_keep_to_the_bound_too(spark):
    counts = spark.range(1, 1001).selectExpr("id AS w", "7 AS c")
    assert [r["w"] for r in most_frequent(counts, "c", 10, "w").collect()] == list(range(1, 11))
