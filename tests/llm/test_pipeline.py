"""The corpus pipeline stage by stage."""

import random
import sys
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_dedup import components_by_hand
from test_text import leaks_by_hand
from wakeline.llm import base, decontaminate, jaccard_join, language_id, line_dedup
from wakeline.llm.base import cut, table


def test_stages_apply_their_decisions(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, data), "stage")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    first = kept["language ID"]
    assert first.count() == table(spark, data, "documents").filter(r"text rlike '\\p{L}'").count()
    again = line_dedup.dedup_lines(kept["line dedup"]).filter("n_dropped > 0").count()
    assert again == 0
    comp = jaccard_join.jaccard_components(kept["n-gram Jaccard join"])
    assert comp.filter("doc_id <> component_id").count() == 0
    assert kept["n-gram Jaccard join"].count() == jaccard_join.jaccard_components(kept["line dedup"]).filter("n_shingles = 0 or doc_id = component_id").count()
    clean = kept["benchmark decontamination"]
    assert decontaminate.find_leaks(clean, table(spark, data, "benchmark")).count() == 0
    assert sorted(r[0] for r in kept["packing"].select("doc_id").collect()) == sorted(r[0] for r in clean.select("doc_id").collect())


def test_run_equals_the_stages(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and {"doc_id", "n_tokens", "bucket_len", "batch_id", "slot"} <= set(rows[0].asDict())


def test_empty_documents(spark, data, tmp_path):
    table(spark, data, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, data, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def pipeline_by_hand(docs, items):
    """(doc_id, text) of the rows that the four filtering stages keep."""
    docs = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for d, t in docs:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(d)
    last = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    cut_docs = [(d, "\n".join(x for x in t.split("\n") if last.get(key(x), d) == d)) for d, t in docs]
    docs = [new for old, new in zip(docs, cut_docs) if new == old or new[1].strip()]

    kept, seen = [], set()
    group = {d: c for d, _, c in components_by_hand(docs, 5, 75)}
    for d, t in docs:
        if d is None or group[d] == d and d not in seen:
            kept.append((d, t))
            seen.add(d)

    leaking = {d for d, _, _ in leaks_by_hand(kept, items)}
    return [(d, t) for d, t in kept if d not in leaking]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "rho", "tau", "zeta", "eta", "phi", "chi", "psi", "omega"], k=n))
    items = [(i, words(20)) for i in range(6)] + [(9, None), (10, "")]
    line = "a line of more than forty characters that many documents share"
    rows = [(i, words(rng.randint(1, 90))) for i in range(60)]
    rows += [(100 + i, f"{words(12)}\n  {line.upper()} \n{words(9)}") for i in range(8)]
    rows += [(120 + i, line) for i in range(3)]  # nothing is left of these
    for i in range(30):  # near copies: some words of a text replaced
        w = rows[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "other"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{words(15)} {items[i % 6][1]} {words(15)}") for i in range(9)]
    rows += [(400, None), (401, ""), (402, "12 ... 7"), (403, "½ ²"), (None, words(30)), (None, words(31)), rows[5], rows[5], (404, "long " * 30_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, rng.choice(["en", "de", None]), "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("lang_pred", "score", "n_dropped", "kept_text", "__wl_id", "n", "slot", "item_id")}).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = pipeline_by_hand(rows, items)
    assert 60 < len(left) < len(rows) - 30
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(t.split())) for d, t in left)


def test_batches_of_long_texts_are_bounded(spark):
    class Watch:
        """In place of a model: the bytes of the batch whose texts are judged."""

        langs = ["x"]

        def predict(self, text):
            return "x", float(sys._getframe(1).f_locals["b"].nbytes)

    class Sent:
        def __reduce__(self):
            return cloudpickle.loads, (cloudpickle.dumps(Watch()),)

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 4000).alias("text"))
    got = language_id.identify(docs, Sent()).agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("size"), F.max("score").alias("most")).first()
    assert (got["n"], got["size"]) == (3000, 72_000_000)
    assert got["most"] < 5 << 20  # all rows at once are 72 MB


def test_workers_give_back_what_they_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(base, "give_back", lambda: calls.append(1))
    t = pa.table({"a": [1]})
    assert base.lean_groups(lambda x: x)(t) is t and calls == [1]
    monkeypatch.undo()
    base.give_back()
