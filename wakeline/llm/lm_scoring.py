"""Cross-entropy difference scores from matched bigram models.

A target and a background model share one vocabulary, order and smoothing; a
document's score is the mean over its tokens of the target's loss minus the
background's.  Counts cover every document and every word:

1. word counts of all documents give the most frequent words a number; all others keep
   their 64-bit hash.  Each text becomes numbers and hashes, written once;
2. counts of the numbered words by model are a bounded table and broadcast;
3. counts of bigrams of numbered words are summed per fragment of the hashed bigrams.
   The most frequent ones, a bounded table, are broadcast and scored where the documents
   are, so that no bigram that many documents hold meets in one task;
4. all other bigrams of numbered words travel to their fragments, which hold all their
   occurrences, count them, and return one partial loss per document and fragment;
5. bigrams that end in a hashed word travel to the fragment of that word, which counts
   it and scores those with a numbered history.  Bigrams with a hashed history travel to
   the fragment of the history, with the count of their word, and are scored there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, discard, most_frequent, small_side
from .tokens import mix64, slices, word_hashes

_U = np.uint64
#: Numbers: 0 stands for a word that keeps its hash, the last is the start of a document.
#: Smaller values are numbers, all others hashes.  Add-one smoothing has at least so many words.
VOCABULARY = 65_536
START = VOCABULARY - 1
#: Words that get a number.
NUMBERED = VOCABULARY - 2
#: Bigrams whose counts are broadcast (12 bytes each).
HOT = 1 << 18
#: Documents of one block of postings.
BLOCK = 2000
FLUSH, FRAGMENT = 2_000_000, 4_000_000
_MIX, _UNMIX = 2654435769, pow(2654435769, -1, 1 << 32)


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], names=["w", "c"])

        for b in batches:
            for _, data, offs in slices(b.column(0)):
                held.append(word_hashes(data, offs)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _numbered(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(d, ids, rare): each text as little-endian 16-bit word numbers, and the hashes of its words without one."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for b in batches:
            for at, data, offs in slices(b.column(1)):
                h, rows = word_hashes(data, offs)
                pos = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                ids = np.where(words[pos] == h, pos + 1, 0).astype(np.uint16) if len(words) else np.zeros(len(h), np.uint16)
                n = len(offs) - 1
                rare = h[ids == 0]
                at_rare = np.concatenate([[0], np.cumsum(ids == 0)])[rows]
                cut_up = [pa.array([x[e[i] : e[i + 1]].tobytes() for i in range(n)], pa.binary()) for x, e in ((ids, rows), (rare, at_rare))]
                yield pa.record_batch([b.column(0).slice(at, n), *cut_up], names=["d", "ids", "rare"])

    return docs.select("d", "text").mapInArrow(run, f"d {docs.schema['d'].dataType.simpleString()}, ids binary, rare binary")


def _bigrams(ids: list[bytes], rare: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mixed 32-bit keys of the bigrams of numbered words and the row of each; history, word and row of all others."""
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), np.uint16).astype(_U)
    flat[flat == 0] = np.frombuffer(b"".join(rare), _U)
    before = np.concatenate([[_U(START)], flat[:-1]]) if len(flat) else flat
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[starts] = START
    row = np.repeat(np.arange(len(ids)), sizes)
    known = np.maximum(before, flat) < VOCABULARY
    key = ((before[known] << _U(16) | flat[known]) * _U(_MIX)) & _U(0xFFFFFFFF)
    return key.astype(np.uint32), row[known], (before[~known], flat[~known], row[~known])


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * _U(0x9E3779B97F4A7C15) + mix64(w))


def _unigrams(numbered: DataFrame) -> DataFrame:
    """(w, target, c): tokens by word number; as histories a document's start counts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, VOCABULARY), np.int64)  # target?, as word or history
        for b in batches:
            for ids, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(ids.as_py(), np.uint16)
                if len(x):
                    counts[int(t), 0] += np.bincount(x, minlength=VOCABULARY)
                    counts[int(t), 1] += np.bincount(x[:-1], minlength=VOCABULARY)
                    counts[int(t), 1, START] += 1
        t, k, w = np.nonzero(counts)
        yield pa.record_batch([pa.array(t.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(counts[t, k, w])], names=["t", "k", "w", "c"])

    return numbered.select("ids", "target").mapInArrow(run, "t int, k int, w int, c long").groupBy("t", "k", "w").agg(F.sum("c").alias("c"))


class Unigrams:
    """Add-one word probabilities and history counts of both models (background 0, target 1)."""

    def __init__(self, rows: list, weight: float, words: int) -> None:
        c = np.zeros((2, 2, VOCABULARY))
        for t, k, w, n in rows:
            c[t, k, w] = n
        self.total = c[:, 0].sum(axis=1, keepdims=True) + max(VOCABULARY, words)
        self.word = self.probability(c[:, 0])
        self.history, self.weight = c[:, 1], weight

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / self.total

    def losses(self, key: np.ndarray, counts: np.ndarray, own: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Losses of mixed keys."""
        plain = (key.astype(_U) * _U(_UNMIX)) & _U(0xFFFFFFFF)
        h, w = (plain >> _U(16)).astype(np.int64), (plain & _U(0xFFFF)).astype(np.int64)
        return self.loss(self.history[:, h], self.word[:, w], counts, own, target)

    def loss(self, history: np.ndarray, word: np.ndarray, counts: np.ndarray, own: np.ndarray, target: np.ndarray) -> np.ndarray:
        """-log p under both models, each with what the document itself holds of the bigram
        (``own``) left out of the model that it belongs to.  history, word, counts: (2, bigrams)."""
        less = np.stack([np.where(target, 0, own), np.where(target, own, 0)])
        seen = history - less
        share = np.where(seen > 0, self.weight, 0.0)
        return -np.log(share * (counts - less) / np.maximum(seen, 1) + (1 - share) * word)


def _fragment_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The fragment of 32-bit keys, or of 64-bit hashes by their upper half."""
    return (key >> _U(32) if key.dtype == _U else key.astype(_U)) * _U(parts) >> _U(32)


def _by_model(which: np.ndarray, c: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(which[m], c[m], minlength=n) for m in (~target, target)])


def _bigram_counts(numbered: DataFrame, parts: int) -> DataFrame:
    """Per fragment the counts of its bigrams in the background and the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            both = np.concatenate(held)  # key << 1 | target
            k, c = np.unique(both, return_counts=True)
            edge = np.searchsorted(_fragment_of((k >> _U(1)).astype(np.uint32), parts), np.arange(parts + 1, dtype=_U))
            at = [f for f in range(parts) if edge[f + 1] > edge[f]]
            return pa.record_batch([pa.array(at, pa.int32()), *(pa.array([x[edge[f] : edge[f + 1]].tobytes() for f in at], pa.binary()) for x in (k, c.astype(np.uint32)))], names=["frag", "k", "c"])

        for b in batches:
            key, row, _ = _bigrams(b.column(0).to_pylist(), b.column(1).to_pylist())
            target = b.column(2).to_numpy(zero_copy_only=False).astype(_U)
            held.append(key.astype(_U) << _U(1) | target[row])
            size += len(key)
            if size >= FLUSH:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def add(t: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x, _U) for x in t.column("k").to_pylist()])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("c").to_pylist()]).astype(np.int64)
        key, which = np.unique(k >> _U(1), return_inverse=True)
        target = (k & _U(1)).astype(bool)
        both = [np.bincount(which[m], c[m], minlength=len(key)).astype(np.int64) for m in (~target, target)]
        return pa.table({"key": key.astype(np.int64), "b": both[0], "t": both[1], "c": both[0] + both[1]})

    return numbered.select("ids", "rare", "target").mapInArrow(run, "frag int, k binary, c binary").groupBy("frag").applyInArrow(add, "key long, b long, t long, c long")


_SENT = "block long, frag int, docs binary, n binary, k binary, rows binary, c binary, bg binary, tg binary, o binary, u binary, blocks binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _rows(**columns: list) -> pa.RecordBatch:
    """Rows of ``_SENT``; columns that are left out are null."""
    n = len(next(iter(columns.values())))
    types = {"block": pa.int64(), "frag": pa.int32()}
    return pa.record_batch([pa.array(columns.get(x, [None] * n), types.get(x, pa.binary())) for x in _NAMES], names=_NAMES)


def _to_bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _score_hot(numbered: DataFrame, unigrams, hot, parts: int) -> DataFrame:
    """Per block of documents: a row with its losses from the broadcast bigrams, and rows with the
    postings (key, document in the block and whether it is a target, count) of all others by fragment:
    those of numbered words up to ``parts``, those that end in a hashed word up to twice that number,
    those with only a hashed history above.  The latter two hold the hash as key and the other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = hot.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                m = part.num_rows
                target = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                ids = part.column(1).to_pylist()
                key, row, (v, w, of) = _bigrams(ids, part.column(2).to_pylist())
                pair, c = np.unique(key.astype(_U) << _U(32) | row.astype(_U), return_counts=True)
                k, r = (pair >> _U(32)).astype(np.uint32), (pair & _U(0xFFFFFFFF)).astype(np.int64)
                pos = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                known = keys[pos] == k if len(keys) else np.zeros(len(k), bool)
                loss = unigrams.value.losses(k[known], counts[:, pos[known]], c[known], target[r[known]]) * c[known]
                sums = [np.bincount(r[known], loss[i], minlength=m).astype(np.float64) for i in (0, 1)]
                block = int.from_bytes(os.urandom(8), "big", signed=True)  # kept: the rows are written before they are used
                yield _rows(block=[block], docs=[_to_bytes(part.select(["d"]))], n=[np.array([len(x) // 2 for x in ids], np.int64).tobytes()], bg=[sums[0].tobytes()], tg=[sums[1].tobytes()])
                k, r, c = k[~known], r[~known], c[~known]
                marked = (r | target[r].astype(np.int64) << 15).astype(np.uint16)
                edge = np.searchsorted(_fragment_of(k, parts), np.arange(parts + 1, dtype=_U))
                at = [f for f in range(parts) if edge[f + 1] > edge[f]]
                cut_up = [[x[edge[f] : edge[f + 1]].tobytes() for f in at] for x in (k, marked, c.astype(np.uint32))]
                yield _rows(block=[block] * len(at), frag=at, k=cut_up[0], rows=cut_up[1], c=cut_up[2])
                _, at, c = np.unique(_pair_hash(_pair_hash(v, w), of.astype(_U)), return_index=True, return_counts=True)
                v, w, r, c = v[at], w[at], of[at], c.astype(np.uint32)
                marked = (r | target[r].astype(np.int64) << 15).astype(np.uint16)
                ends = w >= VOCABULARY
                for first, part_of, k, o in ((parts, ends, w, v), (2 * parts, ~ends, v, w)):
                    at, cut_up = _cut_up(k[part_of], parts, (k[part_of], o[part_of], marked[part_of], c[part_of]))
                    yield _rows(block=[block] * len(at), frag=[first + f for f in at], k=cut_up[0], o=cut_up[1], rows=cut_up[2], c=cut_up[3])

    return numbered.select("d", "ids", "rare", "target").mapInArrow(run, _SENT)


def _cut_up(key: np.ndarray, parts: int, columns: tuple) -> tuple[list[int], list[list[bytes]]]:
    """The fragments of the keys, and per column its bytes in each of them."""
    frag = _fragment_of(key, parts)
    order = np.argsort(frag, kind="stable")
    edge = np.searchsorted(frag[order], np.arange(parts + 1, dtype=_U))
    at = [f for f in range(parts) if edge[f + 1] > edge[f]]
    columns = tuple(x[order] for x in columns)
    return at, [[x[edge[f] : edge[f + 1]].tobytes() for f in at] for x in columns]


def _postings(t: pa.Table) -> tuple:
    """Block, hashed word, other word, document in the block, count and whether it is a target, of the rows of one fragment."""
    k, o, marked, c = (np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()]) for name, kind in (("k", _U), ("o", _U), ("rows", np.uint16), ("c", np.uint32)))
    block = np.concatenate([np.frombuffer(many, np.int64) if many is not None else np.full(len(rows) // 2, one, np.int64) for one, many, rows in zip(*(t.column(x).to_pylist() for x in ("block", "blocks", "rows")), strict=True)])
    return block, k, o, marked, c.astype(np.int64), marked >= 1 << 15


def _partial(block: np.ndarray, marked: np.ndarray, loss: np.ndarray) -> pa.RecordBatch:
    """One row per block with the sums of its documents."""
    blocks, local = np.unique(block, return_inverse=True)
    doc, which = np.unique(local << 15 | (marked & 0x7FFF).astype(np.int64), return_inverse=True)
    edge = np.searchsorted(doc >> 15, np.arange(len(blocks) + 1))
    bg, tg = (np.bincount(which, x, minlength=len(doc)).astype(np.float64) for x in loss)
    cut_up = [[x[edge[i] : edge[i + 1]].tobytes() for i in range(len(blocks))] for x in ((doc & 0x7FFF).astype(np.uint16), bg, tg)]
    return _rows(block=blocks.tolist(), rows=cut_up[0], bg=cut_up[1], tg=cut_up[2])


def _score_ends(unigrams, parts: int):
    """Bigrams that end in the hashed words of one fragment: partial losses of those with a numbered
    history; all others, with both counts of their word, by the fragment of their history."""

    def run(t: pa.Table) -> pa.Table:
        block, w, v, marked, c, target = _postings(t)
        word, which = np.unique(w, return_inverse=True)
        uni = _by_model(which, c, target, len(word))[:, which]
        known = v < VOCABULARY
        pair, which = np.unique(_pair_hash(v[known], w[known]), return_inverse=True)
        counts = _by_model(which, c[known], target[known], len(pair))[:, which]
        model = unigrams.value
        loss = model.loss(model.history[:, v[known].astype(np.int64)], model.probability(uni[:, known]), counts, c[known], target[known]) * c[known]
        on = ~known
        both = uni[:, on].T.astype(np.uint32)
        at, cut_up = _cut_up(v[on], parts, (v[on], w[on], marked[on], c[on].astype(np.uint32), both, block[on]))
        sent = _rows(block=[None] * len(at), frag=[2 * parts + f for f in at], k=cut_up[0], o=cut_up[1], rows=cut_up[2], c=cut_up[3], u=cut_up[4], blocks=cut_up[5])
        return pa.Table.from_batches([_partial(block[known], marked[known], loss), sent])

    return run


def _score_histories(unigrams):
    """Partial losses from the bigrams whose hashed histories are those of one fragment."""

    def run(t: pa.Table) -> pa.Table:
        block, v, w, marked, c, target = _postings(t)
        model = unigrams.value
        word = np.empty((2, len(w)))
        at = 0
        for size, u in zip((len(x) // 8 for x in t.column("k").to_pylist()), t.column("u").to_pylist(), strict=True):
            s = slice(at, at + size)
            word[:, s] = model.word[:, w[s].astype(np.int64)] if u is None else model.probability(np.frombuffer(u, np.uint32).reshape(-1, 2).T)
            at += size
        history, which = np.unique(v, return_inverse=True)
        seen = _by_model(which, c, target, len(history))[:, which]
        pair, which = np.unique(_pair_hash(v, w), return_inverse=True)
        counts = _by_model(which, c, target, len(pair))[:, which]
        return pa.Table.from_batches([_partial(block, marked, model.loss(seen, word, counts, c, target) * c)])

    return run


def _score_rest(unigrams):
    """Partial losses of the documents of each block from the bigrams of one fragment."""

    def run(t: pa.Table) -> pa.Table:
        ks, rows, cs = ([np.frombuffer(x, kind) for x in t.column(name).to_pylist()] for name, kind in (("k", np.uint32), ("rows", np.uint16), ("c", np.uint32)))
        k, marked, c = np.concatenate(ks), np.concatenate(rows), np.concatenate(cs).astype(np.int64)
        target = marked >= 1 << 15
        key, which = np.unique(k, return_inverse=True)
        counts = np.stack([np.bincount(which[m], c[m], minlength=len(key)) for m in (~target, target)])
        loss = unigrams.value.losses(k, counts[:, which], c, target) * c
        out: tuple[list, list, list] = ([], [], [])
        at = 0
        for own in rows:
            used, local = np.unique(own & 0x7FFF, return_inverse=True)
            part = loss[:, at : at + len(own)]
            for col, v in zip(out, (used.astype(np.uint16), np.bincount(local, part[0]), np.bincount(local, part[1])), strict=True):
                col.append(v.tobytes())
            at += len(own)
        return pa.Table.from_batches([_rows(block=t.column("block").to_pylist(), rows=out[0], bg=out[1], tg=out[2])])

    return run


def _add_up(id_type: str):
    """The documents of one block with the sums of their losses."""

    def run(t: pa.Table) -> pa.Table:
        docs, n, sums = None, None, None
        rows = list(zip(*(t.column(x).to_pylist() for x in ("docs", "n", "rows", "bg", "tg")), strict=True))
        for ids, sizes, _, bg, tg in rows:
            if ids is not None:
                docs, n = pa.ipc.open_stream(ids).read_all(), np.frombuffer(sizes, np.int64)
                sums = np.stack([np.frombuffer(bg), np.frombuffer(tg)]).copy()
        for ids, _, used, bg, tg in rows:
            if ids is None:
                sums[:, np.frombuffer(used, np.uint16)] += np.stack([np.frombuffer(bg), np.frombuffer(tg)])
        return pa.table([docs.column("d"), pa.array(sums[0]), pa.array(sums[1]), pa.array(n)], names=["d", "bg", "tg", "n"])

    return run, f"d {id_type}, bg double, tg double, n long"


def score(docs: DataFrame, target_ids: DataFrame, weight: float = 0.7, doc_id: str = "doc_id", text: str = "text", target_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_tokens, loss_target, loss_background, score.

    ``target_ids`` lists the ids of the target's documents; all others are the
    background.  p(w | v) = ``weight`` c(v w) / c(v) + (1 - ``weight``) p(w), with
    add-one p(w) over all words of the table (65,536 at least); a history that a model lacks leaves p(w).  What a document itself
    holds of a bigram is taken off both counts of the model that it belongs to, so
    that no document is compared with itself.  Losses are natural-log
    means per token, rounded to 9 digits; the lower the score, the more target-like.
    A text without words (null, empty) has 0 tokens and null losses; null ids are
    background; repeated rows count as often as they come; empty tables give no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("text"))
    totals = cut(_word_counts(base), "words")
    words = np.sort(most_frequent(totals, "c", NUMBERED, "w").select("w").toArrow().column("w").to_numpy().view(_U))
    named = target_ids.select(F.col(target_id).alias("_t")).filter("_t is not null").distinct()
    marked = _numbered(base, words).join(small_side(named, 16), F.col("d") == F.col("_t"), "left")
    numbered = cut(marked.select("d", "ids", "rare", F.col("_t").isNotNull().alias("target")), "numbered")
    unigrams = spark.sparkContext.broadcast(Unigrams([tuple(r) for r in zip(*(c.to_pylist() for c in _unigrams(numbered).toArrow().columns), strict=True)], weight, totals.count()))
    discard(totals)
    tokens = numbered.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"] // 2
    parts = max(1, -(-tokens // FRAGMENT))
    counts = cut(_bigram_counts(numbered, parts), "bigrams")
    top = most_frequent(counts, "c", HOT, "key").select("key", "b", "t").toArrow().sort_by("key")
    hot = spark.sparkContext.broadcast((top.column("key").to_numpy().astype(np.uint32), np.stack([top.column(x).to_numpy().astype(np.float64) for x in ("b", "t")])))
    discard(counts)
    sent = cut(_score_hot(numbered, unigrams, hot, parts), "postings")
    discard(numbered)
    rest = sent.filter(F.col("frag") < parts).groupBy("frag").applyInArrow(_score_rest(unigrams), _SENT)
    ends = cut(sent.filter(F.col("frag").between(parts, 2 * parts - 1)).groupBy("frag").applyInArrow(_score_ends(unigrams, parts), _SENT), "ends")
    later = sent.filter(F.col("frag") >= 2 * parts).union(ends.filter("frag is not null"))
    rest = rest.union(ends.filter("frag is null")).union(later.groupBy("frag").applyInArrow(_score_histories(unigrams), _SENT))
    added, ddl = _add_up(id_type)
    sums = sent.filter("frag is null").union(rest).groupBy("block").applyInArrow(added, ddl)
    target, background = (F.round(F.when(F.col("n") > 0, F.col(c) / F.col("n")), 9) for c in ("tg", "bg"))
    return sums.select(F.col("d").alias("doc_id"), F.col("n").alias("n_tokens"), target.alias("loss_target"), background.alias("loss_background"), F.round(target - background, 9).alias("score"))
