"""Language ID, URL filters, decontamination and licence scans."""

import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from wakeline.llm import decontaminate, language_id, license_scan, tokens, url_filter
from wakeline.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

# ---- language ID

SAMPLE = [("en", "the house and the garden of the king"), ("en", "this is the weather with the wind"), ("de", "der garten und das haus des koenigs"), ("de", "das wetter mit dem wind ist nicht gut")] * 5


def test_words_first_then_ngrams(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(SAMPLE)] + [(98, None, "en"), (99, "words", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["de", "en"]
    new = spark.createDataFrame([(1, "The HOUSE"), (2, "gartenhaus"), (3, None), (4, "123 ... 45 ½ ² Ⅷ _"), (5, ""), (6, "wind " * 50_000 + "nicht")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "_text", "lang")})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(new, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values()) and len(got) == 6
    # backoff: only the word edges are known of this word, and they speak for neither
    at = model.rows(["яяя"])[0]
    x, y = model.scores[at]
    assert abs(float(x - y)) < 0.2


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.fit(none)
    assert language_id.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    assert language_id.identify(none, model).count() == 0


def test_sample_bounds_what_is_fitted(spark):
    docs = spark.createDataFrame([(i, f"word{i} common", "en") for i in range(50)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_rows=10)
    assert set(model.tables[0][0]) == {"word", "common"} and model.prior.tolist() == [0.0]


def judge_text_by_hand(rows, held, text):
    """Counts of whole words and n-grams by language, plus a half, as in the operator, without its tables."""
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    counts, docs = {}, Counter()
    for d, t, lang in rows:
        if not held[d] and t is not None and lang is not None:
            docs[lang] += 1
            for w in words(t):
                counts.setdefault(0, {}).setdefault(w, Counter())[lang] += 1
                for n in language_id.ORDERS:
                    for i in range(len(w) + 3 - n):
                        counts.setdefault(n, {}).setdefault(f"<{w}>"[i : i + n], Counter())[lang] += 1
    langs = sorted(docs)
    size = {(n, x): sum(c[x] + 0.5 for c in by.values()) for n, by in counts.items() for x in langs}
    log = lambda n, key, x: math.log((counts[n][key][x] + 0.5) / size[n, x])
    total = {x: math.log(docs[x] / sum(docs.values())) for x in langs}
    for w in words(text):
        if w in counts[0]:
            each = [(0, [w])]
        else:
            each = [(n, [g for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in counts.get(n, {})]) for n in language_id.ORDERS]
        n, keys = next(((n, k) for n, k in each if k), (0, []))
        for x in langs if keys else []:
            total[x] += sum(log(n, g, x) for g in keys) / len(keys)
    if not words(text) or not langs:
        return "und", 0.0
    best = max(total.values())
    return max(langs, key=total.get), 1 / sum(math.exp(v - best) for v in total.values())


def test_predictions_equal_a_plain_model(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    rows = [tuple(r) for r in rows] + [(10_001, "neues wort 12 ½", None), (10_002, None, "en"), (10_003, "", "en"), (10_004, "zzz qqq xxq", None)]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(docs, language_id.fit(docs.filter(~language_id.held_out()))).collect()
    for r in out:
        lang, score = judge_text_by_hand(rows, held, r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-3), r["doc_id"]


def test_held_out_accuracy(spark, data):
    out = QUERIES["op8_language_id"](spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert language_id.accuracy(out) > 0.97


# ---- URLs


def judge_by_hand(url, rules, default):
    host, path = url_filter.split_url(url)
    best = None
    for verdict, rule in rules:
        h, p = url_filter.parse_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h.split(".")), len(p), verdict == "block")
            best = max(best or (rank, rule, verdict), (rank, rule, verdict))
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


@pytest.mark.parametrize("most", [200_000, 0])
def test_urls_equal_a_scan_of_the_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_TRIE_RULES", most)
    rng = random.Random(most)
    words = ["a", "b", "example", "org", "com", "x"]
    rules = list({(".".join(rng.choices(words, k=rng.randint(1, 3))) + "/" + rng.choice(["", "a", "a/", "a/b", "ab"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(v, r) for r, v in rules] + URL_RULES
    urls = [rng.choice(["http", "https"]) + "://" + ".".join(rng.choices([*words, "A", "EXAMPLE"], k=rng.randint(1, 4))) + rng.choice(["", "/", "/a", "/a/b?x=/a", "/ab#y", "/abc/d", "?q", "#z"]) for _ in range(300)]
    urls += [None, "", "no scheme/a", "://", "x://HOST:80/Ab", "a://b://c/d", "http://" + "a." * 3000 + "org/" + "p/" * 3000, "http://org", "http://org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("rule", "_url", "_rh", "_b")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, "allow").collect()}
    assert got == {i: judge_by_hand(u, rules, "allow") for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


# ---- decontamination


def leaks_by_hand(docs, items):
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            m = (x or "").lower().split()
            if len(m) >= 5:
                row = [0] * (len(w) + 1)
                for a in m:
                    nxt = [row[0] + 1]
                    for j, b in enumerate(w):
                        nxt.append(min(row[j] + (a != b), row[j + 1] + 1, nxt[-1] + 1))
                    row = nxt
                if min(row) <= decontaminate.allowed(len(m)):
                    out.add((d, i, min(row)))
    return out


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, "too short"), (52, "")]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randint(0, 120))]
        if d % 2:
            i = rng.randrange(12)
            leak = items[i][1].split()
            for _ in range(rng.randint(0, decontaminate.allowed(len(leak)))):
                leak[rng.randrange(len(leak))] = word()
            k = rng.randrange(len(w) + 1)
            w = w[:k] + leak + w[k:]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[3][1].upper()), (102, items[3][1].upper()), (None, "x " * 20_000 + items[4][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item_id", "distance", "__t", "n_words")}).repartition(3)
    got = decontaminate.find_leaks(table, spark.createDataFrame(items, "item_id int, text string"), recall=0.99)
    rows = {(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()}
    want = leaks_by_hand(docs[:-1], items)
    own = {x for x in rows if x[0] is not None}
    assert own <= want and len(own) >= 0.95 * len(want) and (None, 4, 0) in rows
    assert got.filter("doc_id = 102").count() == 2
    for r in got.filter("doc_id is not null").collect():
        stretch = dict(docs)[r["doc_id"]].lower().split()[r["start_word"] : r["end_word"]]
        assert (r["doc_id"], r["item_id"], r["distance"]) in leaks_by_hand([(r["doc_id"], " ".join(stretch))], items)


@pytest.mark.parametrize("most", [512, 0])
def test_recall_in_each_length_class(monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_WALKS", most)
    rng = random.Random(3)
    index = decontaminate.build([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i, n in enumerate([*range(5, 60)] * 3)], 5, 0.95)
    got = decontaminate.recall_by_class(index, 11)
    assert len(got) == 10 and min(got.values()) >= (0.92 if most else 1.0) and (not index.exact if most else not index.walks)


def test_short_items_equal_whole_texts(spark):
    items = spark.createDataFrame([("a", "Yes"), ("b", "two words"), ("c", "one two three four five six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "yes"), (2, "yes yes"), (3, " TWO\twords "), (4, "two words more"), (5, "x one two three four five six")], "doc_id int, text string")
    for some in (items, items.filter("item_id <> 'c'")):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, some).collect()}
        assert got == {(1, "a"), (3, "b")} | ({(5, "c")} if some is items else set())


def test_no_items_and_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.flag_leaking(docs, items).first()["leaked_items"] == [1]
    assert decontaminate.drop_leaking(docs, items).count() == 0


# ---- licences


def test_headers_files_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    prose = "some words about gardens and weather that go on for a while without any notice in them"
    rows = [
        (1, f"{prose}\n{mit}\n{prose}", "r/a/LICENSE"), (2, apache, "r/a/b/COPYING"), (3, prose, "r/a/x"), (4, None, "r/a/b/c/y"), (5, "", "q/z"), (6, prose, None), (7, f"{mit}\n{prose} {prose}", "r/a/own"),
        (7, f"{mit}\n{prose} {prose}", "r/a/own"), (8, "free licence garden of public words", "r/w"), (9, "word " * 50_000, "r/a/long"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string").withColumn("license", F.lit("x")).repartition(2)
    got = {r["doc_id"]: (r["license"], r["how"], r["license_dir"]) for r in license_scan.scan(docs, F.col("p"), is_licence_file=F.col("p").endswith("/LICENSE")).collect()}
    assert got[1][:2] == ("MIT", "header") and got[2][:2] == ("Apache-2.0", "file")
    assert got[3] == ("MIT", "inherited", "r/a") and got[4] == ("Apache-2.0", "inherited", "r/a/b") and got[9][0] == "MIT"
    assert got[5] == got[6] == got[8] == (None, "none", None) and got[7][:2] == ("MIT", "header")
    assert license_scan.scan(docs, F.col("p")).count() == len(rows)
    again = license_scan.scan(spark.createDataFrame([(7, mit, "a/x"), (7, mit, "a/x"), (None, mit, "b/x"), (8, prose, "c/x")], "doc_id long, text string, p string"), F.col("p")).collect()
    assert sorted((str(r["doc_id"]), r["license"], r["score"]) for r in again) == [("7", "MIT", 1.0), ("7", "MIT", 1.0), ("8", None, None), ("None", "MIT", 1.0)]
    assert license_scan.scan(docs.limit(0), F.col("p")).count() == 0


def test_licence_texts_tags_and_the_root(spark):
    texts = {x: [t for y, t in license_scan.TEMPLATES if x == y][-1] for x in ("MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "ISC")}
    wrap = lambda t: "\n".join(" * " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    rows = [(i, f"Copyright 2020 somebody\n\n{wrap(t)}\n", f"d{i}/LICENSE") for i, t in enumerate(texts.values())]
    rows += [(10 + i, f"first line\n\n{wrap(t)}\n\n" + "code words of a program " * 200, f"e{i}/x") for i, t in enumerate(texts.values())]
    rows += [(20, "# SPDX-License-Identifier: ISC\n" + "other words " * 50, "f/x"), (21, "Released under the MIT License", "LICENSE"), (22, "some prose", "g/h/x"), (23, "more prose", "top")]
    rows += [(30 + i, f"plain text number {i} with many other words", f"z/{i}") for i in range(40)]
    got = {r["doc_id"]: (r["license"], r["how"], r["license_dir"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, p string"), F.col("p")).collect()}
    for i, x in enumerate(texts):
        assert got[i][:2] == (x, "file") and got[10 + i][:2] == (x, "header")
    assert got[20][:2] == ("ISC", "header") and got[22] == got[23] == got[30] == ("MIT", "inherited", "")


# ---- hashes and SQL twins


def test_word_and_shingle_hashes():
    import numpy as np
    import pyarrow as pa

    texts = ["The cat", "the  CAT sat on the mat", None, "", "é\x0bÉ é", "a b c d e f", "A B C D E F"]
    for _, data, offs in tokens.slices(pa.array(texts)):
        h, rows = tokens.word_hashes(data, offs)
        assert np.diff(rows).tolist() == [2, 6, 0, 0, 3, 6, 6]
        assert h[0] == h[2] and h[1] == h[3] and h[8] == h[10] != h[9]
        s, at = tokens.shingle_hashes(h, rows, 5)
        assert np.diff(at).tolist() == [1, 2, 0, 0, 1, 2, 2] and (s[at[5] : at[6]] == s[at[6] : at[7]]).all()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    twin = con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(twin.columns) == cols
    at = [twin.columns.index(c) for c in cols]
    assert sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in twin.fetchall())
