"""Words of whole texts as 64-bit hashes, computed over the UTF-8 bytes of an Arrow batch at once.

Separators of both word definitions are ASCII, so cutting bytes cuts the same words as cutting characters.
Two different words share a hash with probability 2**-64; sets and windows are compared by these hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task; a longer single text is handled alone.
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACED = np.ones(256, dtype=bool)
_SPACED[[32, *range(9, 14)]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True

#: Which bytes belong to words: all but ASCII white space, or ASCII letters, digits and all non-ASCII.
KINDS = {"spaced": _SPACED, "alnum": _ALNUM}

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_COEF = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the whole result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _LOWER[data]


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers, at most ``SLICE_BYTES`` + 1."""
    if int(base) not in _powers:
        out = np.full(SLICE_BYTES + 1, base, dtype=np.uint64)
        out[0] = 1
        _powers[int(base)] = np.multiply.accumulate(out)
    return _powers[int(base)][:n]


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over Arrow batches that gives freed memory back when it ends: its worker goes on to other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of at most ``rows`` consecutive rows holding about ``most`` bytes; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, len(column), row + rows)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def bounds(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words, and for each row and the end the number of words before it."""
    inside = KINDS[kind][data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word, of its bytes, by default with A-Z lowered. Words are ranges in rising order that do not overlap.

    About ``SLICE_BYTES`` are handled at once, however long the text, and so are the parts of a longer word.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > SLICE_BYTES:
            total = np.zeros(1, dtype=np.uint64)
            for at in range(lo, hi, SLICE_BYTES):
                part = data[at : min(hi, at + SLICE_BYTES)]
                value = (_BYTE[_LOWER[part] if lower else part] * _power(_BASE, len(part))).sum(dtype=np.uint64, keepdims=True)
                total += value * np.uint64(pow(int(_BASE), at - lo, 1 << 64))
            out[i] = total[0]
        else:
            part, s, e = data[lo:hi], starts[i:j] - lo, ends[i:j] - lo
            rising = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE[_LOWER[part] if lower else part] * _power(_BASE, hi - lo), out=rising[1:])
            out[i:j] = (rising[e] - rising[s]) * _power(_INVERSE, hi - lo + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _COEF[0])


def runs(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Hashes of all runs of ``k`` consecutive words of each row, in order; of a shorter row, but not an empty one, the whole row is its one run."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k if n else 0):
        total += words[i : i + n] * _COEF[i + 1]
    total = mix(total)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(total[a : b - k + 1])
        elif b > a:
            short = (words[a:b] * _COEF[1 : b - a + 1]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + _COEF[63] * np.full(1, b - a, dtype=np.uint64)))
        else:
            out.append(total[:0])
    return out
