"""Numpy kernels over the UTF-8 buffer of an Arrow string column.

Word boundaries are ASCII white space (0x20, 0x09-0x0D), which never occurs
inside a multi-byte UTF-8 sequence, so splitting, lower-casing of A-Z and
hashing all work on bytes.  Every function handles a *slice* of a batch, cut so
that a slice holds about ``SLICE_BYTES`` (a longer text is a slice of its own);
hash intermediates are further cut to that size, so memory per task is bounded
by the slice, plus the arrays of one text when a single text is longer.

Nulls count as empty texts; an empty text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEQ = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            table = np.empty(size, dtype=np.uint64)
            table[0] = 1
            have, step = 1, np.uint64(base)
            while have < size:
                take = min(have, size - have)
                table[have : have + take] = table[:take] * step
                step = step * step
                have += take
            tables.append(table)
        _powers[:] = tables
    return _powers[0], _powers[1]


with np.errstate(over="ignore"):
    _power_tables(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column, null as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a slice: byte range, row and 64-bit hash of each, in order."""

    __slots__ = ("data", "start", "end", "row", "n_rows", "_hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, edges: np.ndarray | None = None):
        self.data = _LOWER[data] if lower else data
        self.n_rows = len(offsets) - 1
        self._hash: np.ndarray | None = None
        solid = ~_SPACE[self.data]
        begin, finish = solid.copy(), solid.copy()
        if len(solid):
            begin[1:] &= ~solid[:-1]
            finish[:-1] &= ~solid[1:]
            if edges is not None:  # further boundaries between bytes i-1 and i
                begin[1:] |= solid[1:] & edges[1:]
                finish[:-1] |= solid[:-1] & edges[1:]
            filled = offsets[:-1] < offsets[1:]
            first, last = offsets[:-1][filled], offsets[1:][filled] - 1
            begin[first] = solid[first]
            finish[last] = solid[last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1

    @property
    def hash(self) -> np.ndarray:
        """Hash of each word's bytes: a polynomial over random byte values."""
        if self._hash is None:
            self._hash = self.prefix_hashes([None])[0]
        return self._hash

    def prefix_hashes(self, sizes: list[int | None]) -> list[np.ndarray]:
        """Hashes of the words' first bytes, for each size; None: of whole words."""
        outs = [np.empty(len(self.start), dtype=np.uint64) for _ in sizes]
        with np.errstate(over="ignore"):
            i, n = 0, len(self.start)
            while i < n:
                base = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.end, base + SLICE_BYTES, "right")))
                stop = self.end[j - 1]
                power, inverse = _power_tables(int(stop - base) + 1)
                total = np.zeros(stop - base + 1, dtype=np.uint64)
                np.cumsum(_BYTE[self.data[base:stop]] * power[: stop - base], out=total[1:])
                s, whole = self.start[i:j] - base, self.end[i:j] - base
                for out, size in zip(outs, sizes, strict=True):
                    e = whole if size is None else np.minimum(whole, s + size)
                    out[i:j] = mix((total[e] - total[s]) * inverse[s] ^ (e - s).astype(np.uint64))
                i = j
        return outs

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words_of(column: pa.Array, lower: bool, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``(first row, end row, words)`` of each slice of a string column."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets, limit):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)


def sequence_hash(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Order-dependent hash of equally long columns of hashes."""
    with np.errstate(over="ignore"):
        acc = np.full(len(parts[0]), mix(np.array([len(parts) + seed * 1000003], dtype=np.uint64))[0], dtype=np.uint64)
        for x in parts:
            acc = mix(acc * _SEQ + x)
    return acc


def shingles(words: Words, k: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, word index of the first word)`` of k-word shingles.

    With ``whole_if_short`` a text of 1 to k-1 words gives its whole sequence as
    its only shingle.
    """
    h, row = words.hash, words.row
    n = len(h)
    if n >= k:
        first = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        out = sequence_hash([h[first + i] for i in range(k)])
    else:
        first, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not whole_if_short or not n:
        return out, row[first], first
    counts = words.counts()
    begin = np.cumsum(counts) - counts
    hs, fs = [out], [first]
    for size in range(1, k):
        at = begin[counts == size]
        if len(at):
            hs.append(sequence_hash([h[at + i] for i in range(size)]))
            fs.append(at)
    first = np.concatenate(fs)
    return np.concatenate(hs), row[first], first


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, by row, then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]
