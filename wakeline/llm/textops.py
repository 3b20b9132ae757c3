"""Vectorised text primitives that the operators of this subpackage run inside ``mapInArrow`` tasks.

A task gets Arrow record batches.  ``chunks`` cuts a batch into runs of whole rows of about ``CHUNK_BYTES`` of text, so
that the temporary arrays stay small whatever the batch holds (one very long text forms a chunk of its own).  Texts are
never decoded into Python strings: all work is on their UTF-8 bytes, a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: White space of the word rule [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; another seed gives another function."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of an odd base modulo 2**64, and those of its inverse."""
    if _powers["n"] < n:
        n = max(n, 2 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


class Chunk(NamedTuple):
    """Whole rows lo..hi of a batch: their bytes, and for each row where it starts and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if not len(column):
        return
    data, at = column_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        part = at[lo : hi + 1] - at[lo]
        yield Chunk(lo, hi, data[at[lo] : at[hi]], part[:-1], part[1:])
        lo = hi


def word_spans(c: Chunk, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each row (and one past) the number of words before it.

    inside: which bytes are in words; by default those that are not white space.
    """
    inside = ~WHITE[c.data] if inside is None else inside
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(c.start) + 1, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[c.start[c.start < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[c.end[c.end > 0] - 1] = False
    ws = np.flatnonzero(inside & ~before)
    we = np.flatnonzero(inside & ~after) + 1
    return ws, we, np.append(np.searchsorted(ws, c.start), len(ws)) if len(c.start) else np.zeros(1, np.int64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of (byte j + 1) * base**j over j < i."""
    up, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    _, down = powers(len(h))
    return (h[end] - h[start]) * down[start]


#: A number for each byte, for a second hash.
_CODES = mix(np.arange(256, dtype=np.uint64), 77)


def second_hash(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 32-bit hash of the bytes at .. at + length, of other numbers for the bytes than ``span_hash``."""
    up, down = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=h[1:])
    return (mix((h[at + length] - h[at]) * down[at], 13) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def word_hashes(c: Chunk, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words before each row; fold: A-Z as a-z."""
    ws, we, rows = word_spans(c)
    h = prefix_hash(LOWER[c.data] if fold else c.data)
    return mix(span_hash(h, ws, we)), rows


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles in text order, and the number of them before each row.

    A row with some, but fewer than n words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(rows)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    out = np.empty(at[-1], np.uint64)
    k = np.uint64(0xD6E8FEB86659FD93)
    if len(words) >= n:
        s = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            s *= k
            s += words[j : len(words) - n + 1 + j]
        full = np.flatnonzero(counts >= n)
        take = np.repeat(rows[full] - at[full], made[full]) + within(at, full, made)
        out[within(at, full, made)] = s[take]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        s = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[rows[i] : rows[i + 1]]:
                s = s * k + w
        out[at[i]] = s
    return mix(out, n), at


def within(at: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions at[r], at[r] + 1, ... of each row r of rows, one after another."""
    m = counts[rows]
    ends = np.cumsum(m)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[rows] - (ends - m), m)


def row_of(rows: np.ndarray) -> np.ndarray:
    """For offsets: the row of each element."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def row_sums(values: np.ndarray, c: Chunk) -> np.ndarray:
    """For a value per byte: its sum over each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[c.end] - total[c.start]


def fold_case(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: A-Z, and the capitals of the Latin-1 supplement."""
    out = LOWER[data]
    after = np.flatnonzero(out[:-1] == 0xC3) + 1
    low = out[after]
    out[after] = np.where((low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low)
    return out


#: Bytes of letters: a-z and A-Z, and all bytes beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def letter_words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of letters in lower case, and the number of such words before each row."""
    ws, we, rows = word_spans(c, LETTER[c.data])
    return mix(span_hash(prefix_hash(fold_case(c.data)), ws, we)), rows


class Vocabulary:
    """A set of 64-bit hashes with places: most others are ruled out by one look into a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(np.asarray(hashes, np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of the hashes that are in the set, and their places in it."""
        may = np.flatnonzero(self.table[(x >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes) or not len(may):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, x[may]), len(self.hashes) - 1)
        good = self.hashes[at] == x[may]
        return may[good], at[good]
