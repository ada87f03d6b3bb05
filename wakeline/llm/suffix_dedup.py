"""Repeated byte strings across documents, found with enhanced suffix arrays.

Every window of ``length`` bytes has one anchor, the ``gram``-byte string with the
least hash inside it, so equal windows meet at equal anchors.  An anchor owns the
windows that chose it; their bytes are its context.

1. Anchors are dealt by hash.  Anchors with equal contexts form a class whose
   first occurrence stays and whose others are repeats as a whole; map tasks
   settle what they hold twice before they send.
2. Where one anchor has different contexts, one context of each class is fetched,
   and an enhanced suffix array (suffix and LCP arrays) is built over them.  A stack
   scan walks its LCP intervals; those of at least ``length`` bytes whose left
   neighbours differ are the maximal repeats, with all their occurrences.
3. All occurrences but the first of every group are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, widened
from .tokens import mix64, prefix_hash, slices, span_hash

_U = np.uint64
FLUSH, FRAGMENT = 200_000, 250_000
#: Bytes of contexts meant for one suffix array.
ARRAY_BYTES = 1_000_000
#: Anchors with more different contexts than this are compared window by window instead of
#: in one suffix array, so that no anchor fills a task.
CROWD = 20_000
_CROWDED = 1 << 62


# ---- suffix arrays -------------------------------------------------------------------------


class SuffixArray:
    """Enhanced suffix array over separate strings; matches never leave a string.

    Only suffixes of at least ``least`` bytes are sorted.  Ranks of prefixes double
    in length (8, 16, 32, ...) and serve both the order and the LCP values.
    """

    def __init__(self, strings: list[bytes], least: int) -> None:
        sizes = np.array([len(s) for s in strings], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(data)
        self.data, self.owner = data, np.repeat(np.arange(len(sizes)), sizes)
        end = self.begin[1:][self.owner] if n else np.zeros(0, np.int64)
        left = end - np.arange(n)
        widest = int(sizes.max(initial=0))
        # eight bytes as a number, zero-filled at the end of a string, then how many of them are real
        head = np.zeros(n, _U)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(8):
            head = (head << _U(8)) | np.where(left > k, padded[k : n + k], 0).astype(_U)
        first = np.lexsort((np.minimum(left, 8), head))
        rank = np.empty(n, np.int64)
        new = np.ones(n, bool)
        new[1:] = (head[first][1:] != head[first][:-1]) | (np.minimum(left, 8)[first][1:] != np.minimum(left, 8)[first][:-1])
        rank[first] = np.cumsum(new)
        self.levels = [(8, rank)]
        width = 8
        while width < widest:
            nxt = np.zeros(n, np.int64)
            inside = left > width
            nxt[inside] = rank[np.flatnonzero(inside) + width]
            code = rank * (n + 2) + nxt
            order = np.argsort(code, kind="stable")
            new[1:] = code[order][1:] != code[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
            self.levels.append((width, rank))
        starts = np.flatnonzero(left >= least)
        self.left = left
        self.sa = starts[np.argsort(rank[starts], kind="stable")]
        self.lcp = self._lcp(self.sa[:-1], self.sa[1:])  # of neighbours

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        room = np.minimum(self.left[a], self.left[b]) if len(a) else out
        for width, rank in reversed(self.levels):
            fits = room - out >= width
            same = np.zeros(len(a), bool)
            same[fits] = rank[a[fits] + out[fits]] == rank[b[fits] + out[fits]]
            out[same] += width
        for _ in range(7):
            fits = out < room
            same = np.zeros(len(a), bool)
            same[fits] = self.data[a[fits] + out[fits]] == self.data[b[fits] + out[fits]]
            out[same] += 1
        return out

    def before(self) -> np.ndarray:
        """The byte left of each suffix in order; at the start of a string a value of its own."""
        at_start = self.sa == self.begin[self.owner[self.sa]]
        return np.where(at_start, 256 + np.arange(len(self.sa)), self.data[np.maximum(self.sa - 1, 0)])


def maximal_repeats(s: SuffixArray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of every maximal repeat of at least ``length`` bytes.

    The stack holds the open LCP intervals; an interval closes when the LCP falls
    below its value, and counts if its suffixes have different left neighbours.
    """
    if len(s.sa) < 2:
        return
    left = s.before()
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    long = np.concatenate([[False], s.lcp >= length, [False]])
    run_at, run_end = np.flatnonzero(long[1:] & ~long[:-1]), np.flatnonzero(~long[1:] & long[:-1])
    for a, z in zip(run_at.tolist(), run_end.tolist(), strict=True):  # suffixes a..z
        stack: list[tuple[int, int]] = []
        for i, value in enumerate([*s.lcp[a:z].tolist(), 0], a):
            lb = i
            while stack and stack[-1][0] > value:
                size, lb = stack.pop()
                if changes[i] != changes[lb]:
                    yield size, s.sa[lb : i + 1]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, lb))


# ---- anchors ------------------------------------------------------------------------------


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, context hash, first window, last window, anchor) within the slice's bytes."""
    n, w = len(data), length - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, _U, _U, np.int64, np.int64, np.int64))
    if n < length:
        return none
    sums = prefix_hash(data)
    at = np.arange(n - gram + 1)
    g = mix64(span_hash(sums, at, at + gram))
    # sliding minimum with the leftmost position in the low bits, as many of them for every slice: what a
    # window picks depends on its own bytes alone
    bits = 32
    v = (g >> _U(bits) << _U(bits)) | at.astype(_U)
    full = np.full(-(-len(v) // w) * w, np.iinfo(_U).max, _U)
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(n - length + 1)
    low = np.minimum(behind[starts], ahead[starts + w - 1])
    pick = (low & _U((1 << bits) - 1)).astype(np.int64)
    # windows inside one row only
    size = np.diff(offs)
    ok = np.zeros(n + 1, np.int32)
    fits = size >= length
    np.add.at(ok, offs[:-1][fits], 1)
    np.add.at(ok, offs[1:][fits] - length + 1, -1)
    good = np.cumsum(ok)[: len(starts)] > 0
    row = np.repeat(np.arange(len(size)), size)
    pick, starts = pick[good], starts[good]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    a = pick[new]
    c = mix64(span_hash(sums, first, last + length) ^ ((last - first).astype(_U) << _U(56)))
    # anchors are minima, so their hashes are small: another hash spreads them over the fragments
    return row[first], mix64(g[a] ^ _U(0xA0761D6478BD642F)), c, first, last, a


_ANCHORS = "frag int, n long, g binary, c binary, rows binary, lo binary, hi binary, a binary, ids binary"
_FOUND = "d long, h long, spans binary, asks binary"


def _per_row(d: np.ndarray, h: np.ndarray, spans: tuple, asks: tuple) -> tuple[list, list, list, list]:
    """Packs spans (row, from, to) and asks (row, g, lo, hi) by row."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    s_row, s_from, s_to = spans
    a_row, a_g, a_lo, a_hi = asks
    so, ao = np.lexsort((s_from, s_row)), np.lexsort((a_lo, a_row))
    pairs = np.stack([s_from[so], s_to[so]], 1).astype(np.uint32)
    calls = np.stack([a_g[ao], a_lo[ao].astype(_U), a_hi[ao].astype(_U)], 1)
    used = np.union1d(s_row, a_row)
    s_at = np.searchsorted(s_row[so], used), np.searchsorted(s_row[so], used, "right")
    a_at = np.searchsorted(a_row[ao], used), np.searchsorted(a_row[ao], used, "right")
    for r, i, j, k, m in zip(used.tolist(), *(x.tolist() for x in (*s_at, *a_at)), strict=True):
        for col, v in zip(out, (int(d[r]), int(h[r]), _merged(pairs[i:j]).tobytes(), calls[k:m].tobytes()), strict=True):
            col.append(v)
    return out


def _merged(pairs: np.ndarray) -> np.ndarray:
    """Union of half-open intervals sorted by start; touching ones join."""
    if len(pairs) < 2:
        return pairs
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > ends[:-1]
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], ends[np.append(at[1:], len(pairs)) - 1]], 1)


def _repeats_by_class(d: np.ndarray, h: np.ndarray, row: np.ndarray, g: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, length: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(spans of all but the first of each class, order, which of the order are firsts)."""
    rank = np.empty(len(d), np.int64)
    rank[np.lexsort((h, d))] = np.arange(len(d))
    order = np.lexsort((lo, rank[row], c, g))
    same = np.zeros(len(order), bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])
    again = order[same]
    return (row[again], lo[again], hi[again] + length), order, ~same


def _send(docs: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """Rows of anchors by fragment, and rows of spans (frag -1) that a task settles alone."""
    ddl = f"{_ANCHORS}, {_FOUND}"

    def pack(held: list[list], d: list, h: list) -> Iterator[pa.RecordBatch]:
        row, g, c, lo, hi, a = (np.concatenate(x) for x in held)
        ids, hs = np.concatenate(d), np.concatenate(h)
        # one row per distinct (id, text): repeated rows are one document
        keys, which = np.unique(np.stack([ids, hs], 1), axis=0, return_inverse=True)
        row = which.reshape(-1)[row]
        ids, hs = keys[:, 0], keys[:, 1]
        spans, order, firsts = _repeats_by_class(ids, hs, row, g, c, lo, hi, a, length)
        same_place = np.zeros(len(order), bool)  # the same row once more is no repeat
        same_place[1:] = (row[order][1:] == row[order][:-1]) & (lo[order][1:] == lo[order][:-1]) & ~firsts[1:]
        spans = tuple(x[~same_place[~firsts]] for x in spans)
        none = np.zeros(0, np.int64)
        own = _per_row(ids, hs, spans, (none, none.astype(_U), none, none))
        order = order[firsts]
        frag = (((g[order] >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
        edge = np.searchsorted(frag, np.arange(parts + 1))
        out: list[list] = [[] for _ in range(9)]
        for f in range(parts):
            o = order[edge[f] : edge[f + 1]]
            if not len(o):
                continue
            used, local = np.unique(row[o], return_inverse=True)
            gaps = np.diff(g[o], prepend=_U(0))
            values = (f, len(o), gaps.tobytes(), c[o].tobytes(), local.astype(np.uint32).tobytes(), lo[o].astype(np.uint32).tobytes(), (hi - lo)[o].astype(np.uint16).tobytes(), (a - lo)[o].astype(np.uint16).tobytes(), np.stack([ids[used], hs[used]], 1).tobytes())
            for col, v in zip(out, values, strict=True):
                col.append(v)
        blank = [None] * len(out[0])
        yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.binary()) for x in out[2:]), *(pa.array(blank, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)
        blank = [None] * len(own[0])
        yield pa.record_batch([pa.array([-1] * len(blank), pa.int32()), pa.array(blank, pa.int64()), *(pa.array(blank, pa.binary()) for _ in out[2:]), pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), pa.array(own[2], pa.binary()), pa.array(own[3], pa.binary())], names=names)

    names = [p.split()[0] for p in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        d: list = []
        h: list = []
        rows = size = 0
        for b in batches:
            ids, hs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for at, data, offs in slices(b.column(2)):
                found = anchors(data, offs, length, gram)
                row, base = found[0], offs[found[0]]
                for x, v in zip(held, (row + rows, found[1], found[2], found[3] - base, found[4] - base, found[5] - base), strict=True):
                    x.append(v)
                n = len(offs) - 1
                d.append(ids[at : at + n])
                h.append(hs[at : at + n])
                rows += n
                size += len(row)
                if size >= FLUSH:
                    yield from pack(held, d, h)
                    held, d, h, rows, size = [[] for _ in range(6)], [], [], 0, 0
        if size:
            yield from pack(held, d, h)

    return docs.select("d", "h", "t").mapInArrow(run, ddl)


def _settle(length: int):
    """Repeats of whole classes in one fragment, and the contexts that need a closer look."""

    def run(t: pa.Table) -> pa.Table:
        parts: list[list] = [[] for _ in range(6)]
        ids, base = [], 0
        for n, g, c, rows, lo, hi, a, who in zip(*(t.column(x).to_pylist() for x in ("n", "g", "c", "rows", "lo", "hi", "a", "ids")), strict=True):
            own = np.frombuffer(who, np.int64).reshape(-1, 2)
            first = np.frombuffer(lo, np.uint32).astype(np.int64)
            for x, v in zip(parts, (np.frombuffer(rows, np.uint32).astype(np.int64) + base, np.cumsum(np.frombuffer(g, _U), dtype=_U), np.frombuffer(c, _U), first, first + np.frombuffer(hi, np.uint16), first + np.frombuffer(a, np.uint16)), strict=True):
                x.append(v)
            ids.append(own)
            base += len(own)
        row, g, c, lo, hi, a = (np.concatenate(x) for x in parts)
        keys, which = np.unique(np.concatenate(ids), axis=0, return_inverse=True)
        row = which.reshape(-1)[row]
        d, h = keys[:, 0], keys[:, 1]
        # repeated rows of the input send the same anchors from several tasks
        place = np.lexsort((lo, row))
        twice = np.zeros(len(row), bool)
        twice[place[1:]] = (row[place][1:] == row[place][:-1]) & (lo[place][1:] == lo[place][:-1])
        row, g, c, lo, hi, a = (x[~twice] for x in (row, g, c, lo, hi, a))
        spans, order, firsts = _repeats_by_class(d, h, row, g, c, lo, hi, a, length)
        o = order[firsts]
        same = np.zeros(len(o), bool)
        same[1:] = g[o][1:] == g[o][:-1]
        several = same.copy()
        several[:-1] |= same[1:]
        o, same = o[several], same[several]
        sizes = np.diff(np.append(np.flatnonzero(~same), len(o)))
        crowded = np.repeat(sizes > CROWD, sizes)
        out = _per_row(d, h, spans, (row[o], g[o], np.where(crowded, lo[o] | _CROWDED, lo[o]), hi[o]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["d", "h", "spans", "asks"])

    return run


_CONTEXTS = "frag int, d long, h long, lo long, ctx binary, windows binary"


def _fetch(length: int, parts: int):
    """The contexts that a row was asked for, dealt by anchor; those of crowded anchors as
    window hashes, dealt by hash, of which a task settles repeats before it sends."""

    def windows(held: list[np.ndarray], out: tuple[list, ...]) -> None:
        w = np.concatenate(held)  # hash, d, h, position
        w = w[np.lexsort((w[:, 3], w[:, 2].view(np.int64), w[:, 1].view(np.int64), w[:, 0]))]
        w = w[np.append(True, (w[1:] != w[:-1]).any(axis=1))]  # repeated rows of the input
        again = np.zeros(len(w), bool)
        again[1:] = w[1:, 0] == w[:-1, 0]
        for d, h, p in w[again][:, 1:].view(np.int64).tolist():
            for col, v in zip(out, (-1, d, h, p, None, None), strict=True):
                col.append(v)
        w = w[~again]
        frag = ((w[:, 0] >> _U(32)) * _U(parts)) >> _U(32)
        edge = np.searchsorted(frag, np.arange(parts + 1, dtype=_U))
        for f in range(parts):
            if edge[f + 1] > edge[f]:
                for col, v in zip(out, (f, None, None, None, None, w[edge[f] : edge[f + 1]].tobytes()), strict=True):
                    col.append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for row in range(b.num_rows):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                d, h, raw = b.column(0)[row].as_py(), b.column(1)[row].as_py(), b.column(2)[row].as_py() or b""
                calls = np.concatenate([np.frombuffer(x, _U).reshape(-1, 3) for x in b.column(3)[row].as_py() if x])
                frag = ((calls[:, 0] >> _U(32)) * _U(parts)) >> _U(32)
                for f, (_, lo, hi) in zip(frag.tolist(), calls.tolist(), strict=True):
                    if lo & _CROWDED:
                        lo -= _CROWDED
                        ctx = np.frombuffer(raw, np.uint8)[lo : hi + length]
                        at = np.arange(len(ctx) - length + 1)
                        hashes = mix64(span_hash(prefix_hash(ctx), at, at + length))
                        held.append(np.stack([hashes, np.full(len(at), d, np.int64).view(_U), np.full(len(at), h, np.int64).view(_U), (at + lo).astype(_U)], 1))
                        size += len(at)
                    else:
                        for col, v in zip(out, (f, d, h, lo, raw[lo : hi + length], None), strict=True):
                            col.append(v)
                if size >= FLUSH:
                    windows(held, out)
                    held, size = [], 0
                yield _contexts(out)
        if held:
            out = ([], [], [], [], [], [])
            windows(held, out)
            yield _contexts(out)

    return run


def _contexts(out: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["frag", "d", "h", "lo", "ctx", "windows"])


def _equal_windows(packed: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(ids, ids, spans) of the windows of crowded anchors that also start earlier."""
    w = np.unique(np.concatenate([np.frombuffer(x, _U).reshape(-1, 4) for x in packed]), axis=0)
    keys, which = np.unique(w[:, 1:3].view(np.int64), axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.lexsort((w[:, 3], which, w[:, 0]))
    again = order[1:][w[order][1:, 0] == w[order][:-1, 0]]
    p = w[again, 3].astype(np.int64)
    return keys[:, 0], keys[:, 1], (which[again], p, p + length)


def _scan(length: int):
    """Maximal repeats among the contexts of one fragment: spans of all occurrences but the first."""

    none = np.zeros(0, np.int64)

    def run(t: pa.Table) -> pa.Table:
        packed = [x for x in t.column("windows").to_pylist() if x]
        d, h, spans = _equal_windows(packed, length) if packed else (none, none, (none, none, none))
        crowd = _per_row(d, h, spans, (none, none.astype(_U), none, none))
        t = t.filter(t.column("ctx").is_valid())
        own = whole(t) if t.num_rows else ([], [], [], [])
        out = [[*a, *b] for a, b in zip(crowd, own, strict=True)]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["d", "h", "spans"])

    def whole(t: pa.Table) -> tuple[list, list, list, list]:
        ids = np.stack([t.column("d").to_numpy(), t.column("h").to_numpy()], 1)
        lo = t.column("lo").to_numpy()
        texts = t.column("ctx").to_pylist()
        # contexts without a window that occurs twice need no suffixes
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        n = np.maximum(0, sizes - length + 1)
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
        value = np.concatenate([mix64(span_hash(prefix_hash(buf[a:z]), at[i:j] - a, at[i:j] - a + length)) for i, j, a, z in _stretches(at, begin, sizes, owner, length)]) if len(at) else np.zeros(0, _U)
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        hit = np.zeros(len(value), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        keep = np.flatnonzero(np.bincount(owner[hit], minlength=len(texts)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys, which = np.unique(ids, axis=0, return_inverse=True)
        which = which.reshape(-1)
        if len(keep):
            s = SuffixArray([texts[i] for i in keep], length)
            own = which[keep]
            pos = lo[keep] - s.begin[:-1]
            for size, starts in maximal_repeats(s, length):
                k = s.owner[starts]
                r, p = own[k], starts + pos[k]
                first = np.lexsort((p, r))[0]
                rest = (r != r[first]) | (p != p[first])
                found.append((r[rest], p[rest], p[rest] + size))
        spans = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
        return _per_row(keys[:, 0], keys[:, 1], spans, (none, none.astype(_U), none, none))

    return run


def _stretches(at: np.ndarray, begin: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of windows over at most about a megabyte of contexts."""
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20))))
        j = int(np.searchsorted(owner, owner[j - 1], "right"))
        last = owner[j - 1]
        yield i, j, int(begin[owner[i]]), int(begin[last] + sizes[last])
        i = j


def _span(lo: Column, length: int) -> Column:
    """One window as two little-endian 32-bit numbers."""
    def low_first(n: Column) -> Column:
        x = F.lpad(F.hex(n), 8, "0")
        return F.unhex(F.concat(*(F.substring(x, i, 2) for i in (7, 5, 3, 1))))

    return F.concat(low_first(lo), low_first(lo + length))


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (array of [from, to)), ``n_removed`` and ``kept`` (binary).

    Removed is every byte inside a string of ``length`` bytes that also starts
    earlier: in a smaller id, or in the same document further left; overlapping
    occurrences count, and strings are judged on the input.  Matches never cross
    documents.  A null text is empty; a null id sorts before all others; rows with
    equal id and text are one document (each gets the same answer), rows with equal
    id and different texts are ordered by a hash of the text.  Ids are integers.
    An empty table gives no rows; columns named like the outputs are replaced.
    """
    docs = docs.drop("n_bytes", "removed", "n_removed", "kept")
    base = docs.withColumns({"__wl_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "__wl_h": F.xxhash64(text), "__wl_t": F.coalesce(F.col(text).cast("binary"), F.lit(b""))})
    keyed = base.select(F.col("__wl_d").alias("d"), F.col("__wl_h").alias("h"), F.col("__wl_t").alias("t"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, round(2 * total / (length - gram + 2) / FRAGMENT))
    sent = _send(keyed, length, gram, parts)
    sent = cut(sent, "anchors")
    own = sent.filter("frag < 0").select("d", "h", "spans")
    met = cut(sent.filter("frag >= 0").drop("d", "h", "spans", "asks").groupBy("frag").applyInArrow(_settle(length), _FOUND), "met")
    asked = met.filter(F.octet_length("asks") > 0)
    room = asked.agg(F.coalesce(F.sum(F.octet_length("asks")), F.lit(0)).alias("n")).first()["n"] // 24 * (2 * length - gram)
    asked = asked.groupBy("d", "h").agg(F.collect_list("asks").alias("asks"))
    once = keyed.join(asked.hint("shuffle_hash"), ["d", "h"])
    arrays = max(1, -(-room // ARRAY_BYTES))
    contexts = cut(once.select("d", "h", "t", "asks").mapInArrow(_fetch(length, arrays), _CONTEXTS), "contexts")
    scanned = contexts.filter("frag >= 0").groupBy("frag").applyInArrow(_scan(length), "d long, h long, spans binary")
    settled = contexts.filter("frag < 0").select("d", "h", _span(F.col("lo"), length).alias("spans"))
    spans = own.union(met.select("d", "h", "spans")).union(scanned).union(settled).filter(F.octet_length("spans") > 0)
    spans = cut(spans.groupBy("d", "h").agg(F.collect_list("spans").alias("__wl_spans")).select(F.col("d").alias("__wl_sd"), F.col("h").alias("__wl_sh"), "__wl_spans"), "spans")
    joined = base.join(spans.hint("shuffle_hash"), (F.col("__wl_d") == F.col("__wl_sd")) & (F.col("__wl_h") == F.col("__wl_sh")), "left")
    names = docs.columns
    wide = joined.select("__wl_t", "__wl_spans", *names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lost, cuts, kept = [], [], [], []
            for t, packed in zip(b.column(0), b.column(1), strict=True):
                raw = t.as_py() or b""
                pairs = np.concatenate([np.frombuffer(x, np.uint32).reshape(-1, 2) for x in packed.as_py() or ()] or [np.zeros((0, 2), np.uint32)])
                pairs = _merged(pairs[np.argsort(pairs[:, 0], kind="stable")]).tolist()
                rest = b"".join(raw[a:z] for (_, a), (z, _) in zip([(0, 0), *pairs], [*pairs, (len(raw), 0)], strict=True))
                sizes.append(len(raw))
                lost.append(len(raw) - len(rest))
                cuts.append(pairs)
                kept.append(rest)
            yield pa.record_batch([*b.columns[2:], pa.array(sizes, pa.int64()), pa.array(cuts, pa.list_(pa.list_(pa.int64()))), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "removed", "n_removed", "kept"])

    return wide.mapInArrow(apply, widened(docs, "n_bytes long, removed array<array<long>>, n_removed long, kept binary"))
