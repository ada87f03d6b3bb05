"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Both documents and items are word sequences (as ``tokens`` splits them).  An item of
m words leaks if some stretch of the document is within ``allowed(m)`` word edits.

* Windows that cannot leak are left out first, without loss: within t edits an item
  keeps at least m - 2 - 3 t of its 3-word grams, so a window with fewer of the
  items' grams holds no leak.
* At every other start the CGK random walk turns the item-sized window into a string
  in which edit distance has become Hamming distance; sampled positions of it form
  the LSH keys.  Walks are repeated until, in every length class, items edited to the
  limit and put in front of other words are found again with the target recall; the
  repetitions are measured on the items, not assumed.
* Every window and item that share a key are verified by exact edit distance.  A length
  class for which ``MOST_WALKS`` walks are too few has its items compared with all
  windows that were not left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches, small_side
from .tokens import mix64, slices, word_hashes

_U = np.uint64
GRAM = 3
#: Sampled positions of a key, and keys of one walk.
BITS, KEYS = 3, 6
#: Window starts that are embedded at a time.
WINDOWS = 20_000
#: Words of benchmark items that are searched for in one pass (about 100 MB of tables).
BLOCK_WORDS = 1_000_000
#: Walks after which a length class is searched without them.
MOST_WALKS = 512
#: Edited copies of each length class by which recall is measured.
COPIES = 1000
_GRAM_CODE = mix64(np.arange(101, 101 + GRAM, dtype=_U)) | _U(1)


def allowed(m: int) -> int:
    """Word edits within which an item of m words counts as leaked: a quarter of it, and
    few enough that at least one 3-word gram must survive."""
    return max(0, min(m // 4, (m - GRAM) // GRAM))


def _grams(h: np.ndarray) -> np.ndarray:
    if len(h) < GRAM:
        return np.zeros(0, _U)
    n = len(h) - GRAM + 1
    return mix64(sum((h[j : j + n] * _GRAM_CODE[j] for j in range(GRAM)), np.zeros(n, _U)))


def _length_class(m: int) -> int:
    """The lower end of the item's length class (steps of a quarter)."""
    c = 5
    while c * 5 // 4 + 1 <= m:
        c = c * 5 // 4 + 1
    return c


def walk_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, classes: list[int]) -> np.ndarray:
    """LSH keys (class, key, start) of CGK walk number ``walk`` from each start; past ``ends`` is padding.
    The keys of a class are the same whichever other classes are asked for."""
    picks = {}
    for c in classes:
        rng = np.random.default_rng([walk, c])
        for k in range(KEYS):
            for j in rng.integers(0, 2 * c, BITS):
                picks.setdefault(int(j), []).append((classes.index(c), k, _U(rng.integers(1, 1 << 63)) | _U(1)))
    out = np.zeros((len(classes), KEYS, len(starts)), _U)
    i = starts.copy()
    for j in range(max(picks) + 1):
        seed = _U((walk * 1_000_003 + j // 64 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        inside = i < ends
        symbol = np.where(inside, h[np.minimum(i, len(h) - 1)], _U(1))
        for c, k, odd in picks.get(j, ()):
            out[c, k] += symbol * odd
        coin = (mix64(symbol ^ seed) >> _U(j % 64)) & _U(1)
        i += (coin.astype(bool) & inside).astype(np.int64)
    salt = np.array(classes, _U)[:, None] * _U(KEYS) + np.arange(KEYS, dtype=_U) + (_U(walk) << _U(32))
    return mix64(out ^ mix64(salt)[:, :, None])


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of text closest to item in word edits; the first such end."""
    ends = _sellers(item, text)
    end = int(ends.argmin())
    back = _sellers(item[::-1], text[:end][::-1])
    return int(ends[end]), end - int(back.argmin()), end


def _sellers(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    col = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for x in item:
        nxt = row + 1
        nxt[1:] = np.minimum(nxt[1:], row[:-1] + (text != x))
        row = np.minimum.accumulate(nxt - col) + col
    return row


@dataclass
class Index:
    ids: list[int]
    items: list[np.ndarray]
    #: the length class of each item (0: shorter than any), and the classes that each walk serves
    of_class: np.ndarray
    walks: list[list[int]]
    #: items that are compared without walks, and those that only a whole text can equal
    exact: list[int]
    short: dict[bytes, list[int]]
    grams: np.ndarray
    bitmap: np.ndarray
    keys: np.ndarray
    owners: np.ndarray
    #: (window words, grams it must hold) by item length
    needs: list[tuple[int, int]]

    def has(self, g: np.ndarray) -> np.ndarray:
        hit = self.bitmap[(g >> _U(42)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = self.grams[np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)] == g[at]
        return hit

    def look_up(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(number of the start, item) pairs that share a key."""
        found: set[tuple[int, int]] = set()
        for w, classes in enumerate(self.walks):
            keys = walk_keys(h, starts, ends, w, classes).reshape(-1, len(starts))
            lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            for r, s in zip(*np.nonzero(hi > lo), strict=True):
                for o in self.owners[lo[r, s] : hi[r, s]].tolist():
                    found.add((int(s), o))
        found.update((s, o) for o in self.exact for s in range(len(starts)))
        return found


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    words = item.tolist()
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(len(words)))
        new = int(rng.integers(1 << 62))
        if kind == 0:
            words[at] = new
        elif kind == 1:
            words.insert(at, new)
        elif len(words) > 1:
            del words[at]
    return np.array(words, _U)


@dataclass
class _Copies:
    """Items edited to the limit, each in front of other words."""

    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray], of_class: np.ndarray, seed: int) -> _Copies:
        rng = np.random.default_rng(seed)
        chosen = np.concatenate([rng.choice(np.flatnonzero(of_class == c), COPIES) for c in np.unique(of_class[of_class > 0])])
        parts = [np.concatenate([_edited(items[i], allowed(len(items[i])), rng), rng.integers(1, 1 << 62, len(items[i])).astype(_U)]) for i in chosen]
        at = np.cumsum([0, *map(len, parts)])
        return cls(np.concatenate(parts), at[:-1], at[1:], chosen)


def recall_by_class(index: Index, seed: int) -> dict[int, float]:
    """The share of newly edited copies that the index finds at their true starts, by length class."""
    if not (index.of_class > 0).any():
        return {}
    c = _Copies.of(index.items, index.of_class, seed)
    found = index.look_up(c.words, c.starts, c.ends)
    got = np.array([(i, o) in found for i, o in enumerate(c.item.tolist())])
    return {int(k): float(got[index.of_class[c.item] == k].mean()) for k in np.unique(index.of_class[c.item])}


def build(rows: list[tuple], min_words: int, recall: float) -> Index | None:
    """The LSH index of the items (id, text), with as many walks as ``recall`` takes in each length class."""
    ids, items = [], []
    for at, data, offs in slices(pa.array([t for _, t in rows], pa.string())):
        h, words = word_hashes(data, offs)
        for i in range(len(words) - 1):
            if words[i + 1] > words[i]:
                ids.append(rows[at + i][0])
                items.append(h[words[i] : words[i + 1]].copy())
    if not items:
        return None
    of_class = np.array([_length_class(len(x)) if len(x) >= min_words else 0 for x in items])
    short: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(of_class == 0).tolist():
        short.setdefault(items[i].tobytes(), []).append(i)
    long = np.flatnonzero(of_class)
    grams = np.unique(np.concatenate([np.zeros(0, _U), *(_grams(items[i]) for i in long)]))
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(grams >> _U(42)).astype(np.int64)] = True
    needs = sorted({(m + allowed(m), m - GRAM + 1 - GRAM * allowed(m)) for m in (len(items[i]) for i in long)})
    keys, owners, walks, active = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [], sorted(set(of_class[long].tolist()))
    if active:
        c = _Copies.of(items, of_class, 7)
        flat, at = np.concatenate(items), np.cumsum([0, *map(len, items)])
        got = np.zeros(len(c.item), bool)
    while active and len(walks) < MOST_WALKS:
        mine, theirs = np.flatnonzero(np.isin(of_class, active)), np.flatnonzero(np.isin(of_class[c.item], active))
        row = np.searchsorted(active, of_class[mine])
        own = np.zeros((len(items), KEYS), _U)
        own[mine] = walk_keys(flat, at[mine], at[mine + 1], len(walks), active)[row, :, np.arange(len(mine))]
        seen = walk_keys(c.words, c.starts[theirs], c.ends[theirs], len(walks), active)[np.searchsorted(active, of_class[c.item[theirs]]), :, np.arange(len(theirs))]
        got[theirs] |= (seen == own[c.item[theirs]]).any(axis=1)
        keys.append(own[mine].reshape(-1))
        owners.append(np.repeat(mine, KEYS))
        walks.append(active)
        active = [k for k in active if got[of_class[c.item] == k].mean() < recall]
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    return Index(ids, items, of_class, walks, np.flatnonzero(np.isin(of_class, active)).tolist(), short, grams, bitmap, key[order], owner[order], needs)


def _search(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, start word, end word) of the leaks in a batch."""
    fewest = min((n for _, n in index.needs), default=0)
    longest = max(map(len, index.short), default=0) // 8
    for at, data, offs in slices(texts):
        h, words = word_hashes(data, offs)
        for r in np.flatnonzero((np.diff(words) > 0) & (np.diff(words) <= longest)).tolist():
            for o in index.short.get(h[words[r] : words[r + 1]].tobytes(), ()):
                yield at + r, o, 0, 0, len(index.items[o])
        if len(h) < GRAM or not index.needs:
            continue
        hits = np.zeros(len(h) + 1, np.int64)
        own = index.has(_grams(h))
        row = np.repeat(np.arange(len(words) - 1), np.diff(words))
        own &= row[: len(own)] == row[GRAM - 1 :]
        np.cumsum(own, out=hits[1 : len(own) + 1])
        hits[len(own) + 1 :] = hits[len(own)]
        first = np.searchsorted(np.flatnonzero(own), words)
        starts, ends, of_row = [], [], []
        for r in np.flatnonzero(np.diff(first) >= fewest).tolist():
            a, z = int(words[r]), int(words[r + 1])
            p = np.arange(a, z)
            maybe = np.zeros(z - a, bool)
            for size, need in index.needs:
                maybe |= hits[np.minimum(p + size, z)] - hits[p] >= need
            some = p[maybe]
            starts.append(some)
            ends.append(np.full(len(some), z))
            of_row.append(np.full(len(some), r))
        if not starts:
            continue
        starts, ends, of_row = np.concatenate(starts), np.concatenate(ends), np.concatenate(of_row)
        spots: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(starts), WINDOWS):
            part = slice(lo, lo + WINDOWS)
            for i, o in index.look_up(h, starts[part], ends[part]):
                spots.setdefault((int(of_row[lo + i]), o), []).append(int(starts[lo + i]))
        for (r, o), found in sorted(spots.items()):
            a, z = int(words[r]), int(words[r + 1])
            best = _verify(index.items[o], h[a:z], [s - a for s in sorted(found)])
            if best:
                yield at + r, o, *best


def _verify(item: np.ndarray, words: np.ndarray, found: list[int]) -> tuple[int, int, int] | None:
    """The closest stretch near the starts that LSH found, if it is within the allowed edits."""
    m, t = len(item), allowed(len(item))
    best = None
    lo, reach = found[0] - t, found[0] + m + 2 * t
    for s in [*found[1:], None]:
        if s is not None and s - t <= reach:
            reach = s + m + 2 * t
            continue
        lo = max(0, lo)
        d, x, y = infix_distance(item, words[lo:reach])
        if d <= t and (best is None or d < best[0]):
            best = (d, lo + x, lo + y)
        if s is not None:
            lo, reach = s - t, s + m + 2 * t
    return best


def find_leaks(docs: DataFrame, items: DataFrame, recall: float = 0.97, min_words: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, distance, n_words, start_word, end_word.

    Verified matches are exact; the search finds a match at the largest allowed
    distance with probability ``recall`` or more and closer ones with more.  Null and
    empty texts match nothing, and items without words or with a null text are nothing
    to find.  An item of fewer than ``min_words`` words is no passage that a document
    could hold by leak: it matches only a text that has its words and no others.
    Repeated rows are reported each; empty tables give no rows.  Items are searched
    for in blocks of at most ``BLOCK_WORDS`` words, each block broadcast.
    """
    spark = docs.sparkSession
    kind, id_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType
    passages = items.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("__wl_i"), F.col(item_text).alias("__wl_t"))
    n = passages.agg(F.coalesce(F.sum(F.regexp_count("__wl_t", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-n // BLOCK_WORDS))
    ddl = f"doc_id {kind}, item_id {id_type.simpleString()}, distance int, n_words int, start_word int, end_word int"
    out = spark.createDataFrame([], ddl)
    for b in range(blocks):
        rows = [tuple(r) for r in passages.filter(F.pmod(F.xxhash64("__wl_i", "__wl_t"), F.lit(blocks)) == b).orderBy("__wl_i", "__wl_t").collect()]
        index = build(rows, min_words, recall)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            ix = shared.value
            item_type = to_arrow_type(id_type)
            for batch in batches:
                found = list(_search(ix, batch.column(1)))
                if not found:
                    continue
                row, o, d, a, z = zip(*found, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array([ix.ids[i] for i in o], item_type), pa.array(d, pa.int32()), pa.array([len(ix.items[i]) for i in o], pa.int32()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["doc_id", "item_id", "distance", "n_words", "start_word", "end_word"])

        part = map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, ddl)
        out = part if blocks == 1 else out.union(part)
    return out


def drop_leaking(docs: DataFrame, items: DataFrame, recall: float = 0.97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents (ids) in which an item leaks; columns stay as they are."""
    leaks = cut(find_leaks(docs, items, recall, doc_id=doc_id, text=text).select(F.col("doc_id").alias("__wl_id")).distinct(), "leaks")
    return docs.join(small_side(leaks, 16), docs[doc_id].eqNullSafe(leaks["__wl_id"]), "left_anti")


def flag_leaking(docs: DataFrame, items: DataFrame, recall: float = 0.97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``leaked_items``, the sorted ids of the items found in each document's id (or null)."""
    docs = docs.drop("leaked_items")
    leaks = find_leaks(docs, items, recall, doc_id=doc_id, text=text).groupBy(F.col("doc_id").alias("__wl_id")).agg(F.sort_array(F.collect_set("item_id")).alias("leaked_items"))
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks["__wl_id"]), "left").drop(leaks["__wl_id"])
