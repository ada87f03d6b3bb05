"""Vectorised word and shingle hashing over Arrow text columns.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z is
lower-cased; both rules are byte-wise and therefore exact for UTF-8.  Every
function takes whole texts, works on slices of whole documents of about
``CHUNK`` bytes (a longer document forms a slice of its own), and keeps memory
in proportion to one slice.

Hashes are 64 bits wide: polynomial over the bytes of a word with random byte
codes, then a finaliser; a shingle combines word hashes with odd multipliers and
the same finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
#: The codes of bytes with A-Z lower-cased.
_LOWER_CODE = _CODE[_LOWER]
_SHINGLE = mix64(np.arange(11, 75, dtype=_U)) | _U(1)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", _BASE), ("down", _INV)):
                x = np.full(size, base, _U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_hash(data: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """len(data) + 1 prefix sums; ``span_hash`` turns two of them into a hash."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(code[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unfinished hashes of data[start:end]; equal bytes give equal values."""
    _, down = _POWERS.get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) for runs of whole rows; null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, offsets, body = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1)
        yield row, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per row the index of its first word (rows + 1 of them)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[0] = edge[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word in order, and per row the index of its first word."""
    starts, ends, rows = words(data, offs)
    return mix64(span_hash(prefix_hash(data, _LOWER_CODE), starts, ends)), rows


def shingle_hashes(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and per row the index of its first.

    A row with 1 to k - 1 words has one shingle, its whole sequence; a row
    without words has none.
    """
    counts = np.diff(rows)
    per_row = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_rows = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(out_rows[-1], _U)
    n = len(h)
    if n >= k:
        full = np.zeros(n - k + 1, _U)
        for j in range(k):
            full += h[j : n - k + 1 + j] * _SHINGLE[j]
        keep = np.zeros(n + 1, np.int32)
        long = counts >= k
        np.add.at(keep, rows[:-1][long], 1)
        np.add.at(keep, rows[1:][long] - k + 1, -1)
        mask = np.cumsum(keep)[: n - k + 1] > 0
        into = np.repeat(long, per_row)
        out[into] = full[mask]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        part = h[rows[r] : rows[r + 1]]
        out[out_rows[r]] = np.append(part * _SHINGLE[: len(part)], _SHINGLE[40 + len(part) : 41 + len(part)]).sum(dtype=_U)
    return mix64(out), out_rows
