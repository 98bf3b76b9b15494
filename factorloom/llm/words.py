"""Words and word-gram hashes of Arrow text columns, on the UTF-8 bytes of many rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = {"byte": U(0x9E3779B97F4A7C15 | 3), "word": U(0xC2B2AE3D27D4EB4F | 3), "second": U(0xD6E8FEB86659FD93 | 3)}
# Bytes of text worked on at once; a longer single text makes a slice of its own.
SLICE = 1 << 20

# ASCII white space separates; other bytes are kept.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32

_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and of its inverse."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        size = max(n, 1 << 16)
        base = BASE[kind]
        inverse = U(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[kind] = np.cumprod(up), np.cumprod(down)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Polynomial hash of codes[start:end] for each pair, from one running sum."""
    up, down = powers(kind, len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


@dataclass
class Words:
    """Words of some rows: byte ranges in ``data``, the row of each, their hashes, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(rows) + 1

    def grams(self, k: int, kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all k-grams that lie in one row."""
        if len(self.row) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])
        return at, self.spans(at, at + k, kind)

    def spans(self, starts: np.ndarray, ends: np.ndarray, kind: str = "word") -> np.ndarray:
        """Hash of the word sequence between two word numbers."""
        return mix(run_hashes(self.hashes, starts, ends, kind) + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def flat(column) -> pa.Array:
    """One Arrow string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, UTF-8 bytes and row offsets of runs of rows of about ``size`` bytes."""
    arr = flat(column)
    if not len(arr):
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(arr), lo + 4096)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME) -> Words:
    """All maximal runs of kept bytes; ``fold`` maps bytes before hashing."""
    n = len(data)
    inside = keep[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    folded = fold[data]
    hashes = mix(run_hashes(BYTE_CODE[folded], starts, ends, "byte") + (ends - starts).astype(np.uint64))
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    return Words(folded, starts, ends, row, hashes, first)


def lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.ListArray:
    """An Arrow list array of consecutive runs of values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, where its smallest value stands (the leftmost of equal ones)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(h)), 1
    while width < w:
        step = min(width, w - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        width += step
    return at
