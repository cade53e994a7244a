"""Words, lines and shingles of a batch of texts as numpy arrays over the UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. All of these are ASCII, so cutting bytes never cuts a code point. Hashes are 64-bit:
a polynomial over randomised byte values, mixed; equal strings always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BLOCK = 1 << 20  # bytes hashed at once; bounds the temporaries, not the text
_SEEDED = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SIGN = np.zeros(256, bool)  # ASCII other than letters and digits
_SIGN[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(max(n, 1024), U(base))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Texts:
    """Some rows of a string column: their bytes, and where each row starts and ends in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, at: np.ndarray) -> np.ndarray:
        """How many marks each row has; ``at`` is a boolean per byte."""
        before = np.concatenate([[0], np.cumsum(at)])
        return before[self.offsets[1:]] - before[self.offsets[:-1]]

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, "right") - 1


def text_slices(column: pa.Array, most: int = _BLOCK) -> Iterator[Texts]:
    """The rows of a string column (null: empty) in runs of about ``most`` bytes; no row is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hash of each span ``data[start:end]``; spans in order and without overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        up, down = _powers(high - low + 1)
        part = data[low:high]
        values = _BYTE_VALUES[_LOWER[part] if lower else part] * up[: high - low]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        at = stop
    return out


@dataclass
class Words:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words(texts: Texts, lower: bool = False, plain: bool = False) -> Words:
    """The words of each row; ``plain`` cuts at all ASCII signs, not at white space only."""
    solid = ~(_SIGN if plain else _SPACE)[texts.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[texts.offsets] = True
    blank_before = np.concatenate([[True], ~solid[:-1]]) if len(solid) else solid
    blank_after = np.concatenate([~solid[1:], [True]]) if len(solid) else solid
    start = np.flatnonzero(solid & (edge[:-1] | blank_before))
    end = np.flatnonzero(solid & (edge[1:] | blank_after)) + 1
    return Words(texts.row_of(start), start, end, hash_spans(texts.data, start, end, lower))


@dataclass
class Lines:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray


def lines(texts: Texts) -> Lines:
    """Every newline-separated line of every row, blank ones too; a row has one line at least."""
    breaks = np.flatnonzero(texts.data == 10)
    start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]), kind="stable")
    row = np.sort(np.concatenate([np.arange(texts.rows), texts.row_of(breaks)]), kind="stable")
    end = np.sort(np.concatenate([texts.offsets[1:], breaks]), kind="stable")
    return Lines(row, start, end, np.arange(len(row)) - np.searchsorted(row, row))


def chain(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive entries of one row, and where each window starts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(row[:n] == row[size - 1 :])
    out = np.zeros(len(whole), np.uint64)
    for k in range(size):
        out = mix(out * U(_BASE) + hashes[whole + k] + U(k + 1))
    return out, whole


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle of lower-cased words, sorted by row and hash.

    A row with fewer words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    found = words(texts, lower=True)
    hashes, at = chain(found.hash, found.row, size)
    rows = found.row[at]
    counts = np.bincount(found.row, minlength=texts.rows)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            first = np.searchsorted(found.row, short)
            whole = np.full(len(short), U(n))
            for k in range(n):
                whole = mix(whole * U(_BASE) + found.hash[first + k])
            hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], hashes[new]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
