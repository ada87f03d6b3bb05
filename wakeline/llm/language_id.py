"""Language identification with word-first backoff.

A known word scores by its per-language log frequency.  An unseen word falls back
to the longest character n-grams (orders 5 down to 1, with word edges) of which the
model knows any.  The model is fitted on a bounded, hash-chosen sample of labelled
rows and keeps every word and n-gram of it, so the sample bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, discard, map_batches, widened

#: ASCII other than letters becomes blanks; of what lies beyond ASCII, ``isalpha`` decides.
_BLANKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
_CACHE = 200_000
#: Distinct words that a task counts before it sends them.
FLUSH_WORDS = 100_000


def word_counts(text: str) -> Counter:
    """How often each word occurs: maximal runs of letters (``str.isalpha``) of the lower-cased text."""
    counts = Counter(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).decode("utf-8", "surrogatepass").split())
    for token in [w for w in counts if not w.isalpha()]:
        n = counts.pop(token)
        for w in "".join(c if c.isalpha() else " " for c in token).split():
            counts[w] += n
    return counts


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    #: order (0: whole words) -> row of each gram, and log probabilities by row and language
    tables: dict[int, tuple[dict[str, int], np.ndarray]]
    #: words met so far -> rows of their scores
    seen: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    logs: np.ndarray | None = None
    start: dict[int, int] = field(default_factory=dict)

    def rows(self, words: Iterable[str]) -> list[int]:
        """The rows of the words' scores; those of new words are worked out together."""
        if self.scores is None:
            self.scores = np.zeros((_CACHE, len(self.langs)), np.float32)
            # one table of all orders, with a row of zeros for words of which nothing is known
            self.start = dict(zip(self.tables, np.cumsum([0, *(len(logs) for _, logs in self.tables.values())]).tolist(), strict=False))
            self.logs = np.concatenate([*(logs for _, logs in self.tables.values()), np.zeros((1, len(self.langs)), np.float32)])
        if len(self.seen) > _CACHE // 2:
            self.seen.clear()
        seen = self.seen
        words = list(words)
        new = [w for w in words if w not in seen]
        if new:
            first = len(seen)
            while first + len(new) > len(self.scores):  # one text has more words than the table
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            entries, sizes = [], []
            for i, w in enumerate(new, first):
                found = self.entries(w)
                entries += found
                sizes.append(len(found))
                seen[w] = i
            n = np.array(sizes)
            self.scores[first : first + len(new)] = np.add.reduceat(self.logs[entries], np.cumsum(n) - n) / n[:, None]
        return [seen[w] for w in words]

    def entries(self, w: str) -> list[int]:
        """The rows of the joined table whose mean is the word's score: its own, or those of its longest known n-grams."""
        i = self.tables[0][0].get(w)
        if i is not None:
            return [self.start[0] + i]
        padded = f"<{w}>"
        for n in ORDERS:
            known, at = self.tables[n][0], self.start[n]
            hits = [at + known[g] for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in known]
            if hits:
                return hits
        return [len(self.logs) - 1]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = word_counts(text or "")
        if not counts or not self.langs:
            return UNDETERMINED, 0.0
        rows = self.rows(counts)
        total = self.prior + np.fromiter(counts.values(), float, len(rows)) @ self.scores[rows]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order_by: str = "doc_id", sample_rows: int = 5_000) -> Model:
    """Fits on the ``sample_rows`` labelled rows with the smallest hash of ``order_by``.

    Rows with a null text, lang or id are left out; without any, the model knows no
    language and predicts ``und``.  ``sample_rows`` is the only bound: all words and
    n-grams of the sample's whole texts reach the driver and form the model.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = labelled.select(F.col(order_by).alias("__wl_id")).filter("__wl_id is not null").distinct().orderBy(F.xxhash64("__wl_id"), "__wl_id").limit(sample_rows)
    rows = labelled.join(F.broadcast(ids), labelled[order_by] == ids["__wl_id"], "left_semi").select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def send(by_lang: dict[str, Counter], docs: Counter) -> Iterator[pa.RecordBatch]:
        """Counts of words and n-grams by language; one order at a time, in pieces."""

        def piece(order: int, code: str, items: list[tuple[str, int]]) -> pa.RecordBatch:
            grams_, n = zip(*items, strict=True)
            return pa.record_batch([pa.array([order] * len(items), pa.int32()), pa.array(grams_, pa.string()), pa.array([code] * len(items), pa.string()), pa.array(n, pa.int64())], names=["n", "gram", "lang", "c"])

        for code, words in by_lang.items():
            yield piece(-1, code, [("", docs[code])])
            for order in (0, *ORDERS):
                c = words
                if order:
                    c = Counter()
                    for w, n in words.items():
                        for g in grams(w, order):
                            c[g] += n
                items = iter(c.items())
                while part := list(islice(items, 50_000)):
                    yield piece(order, code, part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}
        docs: Counter = Counter()
        for b in batches:
            for code, t in zip(b.column(0), b.column(1), strict=True):
                code = code.as_py()
                by_lang.setdefault(code, Counter()).update(word_counts(t.as_py()))
                docs[code] += 1
            if sum(map(len, by_lang.values())) > FLUSH_WORDS:
                yield from send(by_lang, docs)
                by_lang, docs = {}, Counter()
        yield from send(by_lang, docs)

    counts = map_batches(rows, count, "n int, gram string, lang string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    table = cut(counts, "grams")
    docs = {r["lang"]: r["c"] for r in table.filter("n = -1").collect()}
    langs = sorted(docs)
    prior = np.log(np.array([docs[x] for x in langs], float) / sum(docs.values()))
    tables = {}
    for n in (0, *ORDERS):
        part = table.filter(F.col("n") == n).select("gram", "lang", "c").toArrow().combine_chunks()
        gram, lang = (pc.dictionary_encode(part.column(c)).combine_chunks() for c in ("gram", "lang"))
        known = gram.dictionary.to_pylist()
        m = np.full((len(known), len(langs)), 0.5)
        of = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)
        np.add.at(m, (gram.indices.to_numpy(), of[lang.indices.to_numpy()] if len(of) else of), part.column("c").to_numpy())
        tables[n] = ({g: i for i, g in enumerate(known)}, np.log(m / m.sum(axis=0)).astype(np.float32) if known else np.zeros((0, len(langs)), np.float32))
    discard(table)
    return Model(langs, prior, tables)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior probability, 0 to 1).

    A null text or one without letters is ``und`` with score 0.  Whole texts are
    read; an empty table gives an empty table; columns named like the outputs are
    replaced, all others pass through.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(at)]
            yield pa.record_batch([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return map_batches(docs, judge, widened(docs, "lang_pred string, score double"))


def accuracy(predicted: DataFrame) -> float:
    """Share of held-out labelled rows that are predicted right; NaN without any."""
    got = predicted.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    return math.nan if got is None else got
