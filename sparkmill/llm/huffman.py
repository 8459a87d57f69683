"""Canonical length-limited Huffman codes for id streams, in blocks that decode alone from bit-offset checkpoints."""

from __future__ import annotations

import numpy as np

#: Longest code, in bits; 2**LIMIT symbols at most.
LIMIT = 16
#: Ids between two checkpoints.
EVERY = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code (0: never occurs), the least total for codes of at most ``limit`` bits (package-merge)."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    level, leaves = weights, [np.ones(len(used), dtype=bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([weights, level[:even:2] + level[1:even:2]])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < len(weights))
    take = 2 * len(used) - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        out[used[:own]] += 1
        take = 2 * (take - own)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    out = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for s in order:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        out[s] = code
        code += 1
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> tuple[bytes, bytes]:
    """``(bits, checkpoints)``: the packed codes and, for every ``EVERY``-th id, its bit offset as unsigned 64-bit."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at, bits = end - size, int(end[-1]) if len(ids) else 0
    units = np.zeros((bits >> 4) + 2, dtype=np.uint32)
    for lo in range(0, len(ids), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        code = table[ids[part]] << (2 * LIMIT - (at[part] & 15) - size[part]).astype(np.uint32)  # a code lies in its unit of 16 bits and the next
        first = int(at[lo]) >> 4
        unit = (at[part] >> 4) - first
        for half, shift in ((code >> LIMIT, 0), (code & ((1 << LIMIT) - 1), 1)):
            sums = np.bincount(unit, half)  # no two codes share a bit
            units[first + shift : first + shift + len(sums)] += sums.astype(np.uint32)
    return units.astype(">u2").tobytes()[: (bits + 7) // 8], at[::EVERY].astype("<u8").tobytes()


def decode_table(lengths: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ``LIMIT`` bits that may come next: the symbol, and the bits it takes."""
    symbol = np.zeros(1 << LIMIT, dtype=np.uint32)
    size = np.zeros(1 << LIMIT, dtype=np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(table[used].astype(np.int64) << (LIMIT - lengths[used].astype(np.int64)))]
    span = 1 << (LIMIT - lengths[used].astype(np.int64))
    symbol[: span.sum()] = np.repeat(used, span)
    size[: span.sum()] = np.repeat(lengths[used], span)
    return symbol, size


def decode(bits: bytes, checkpoints: bytes, n: int, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All ids between checkpoints advance together, one table look-up each."""
    raw = np.frombuffer(bits + b"\0" * 4, dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(checkpoints, dtype="<u8").astype(np.int64)
    out = np.zeros((EVERY, len(at)), dtype=np.uint32)
    for k in range(EVERY):
        if k == n - (len(at) - 1) * EVERY:  # the last stretch is shorter
            at = at[:-1]
        key = (window[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
        out[k, : len(at)] = symbol[key]
        at = at + size[key]
    return out.T.ravel()[:n] if n else np.zeros(0, np.uint32)
