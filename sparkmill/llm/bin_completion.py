"""Bin completion over a histogram of lengths: how many pieces there are of each length, never the pieces themselves.

Its input has at most one entry for each length up to the capacity, however many documents there are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np

#: A filling of one sequence (lengths, longest first) and how many sequences are filled so.
Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, equal pieces and equally filled sequences at once."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    done: dict[tuple[int, ...], int] = {}

    def put(filling: tuple[int, ...], left: int, n: int) -> None:
        where = room.setdefault(left, {}) if left else done
        where[filling] = where.get(filling, 0) + n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            left = min((r for r, x in room.items() if r >= length and x), default=None)
            if left is None:
                each = min(capacity // length, n)
                bins = n // each
                put((length,) * each, capacity - each * length, bins)
                n -= bins * each
                continue
            filling, bins = next(iter(room[left].items()))
            each = min(left // length, n)
            used = min(bins, n // each)
            room[left][filling] -= used
            if not room[left][filling]:
                del room[left][filling]
                if not room[left]:
                    del room[left]
            put(filling + (length,) * each, left - each * length, used)
            n -= used * each
    for x in room.values():
        for filling, n in x.items():
            done[filling] = done.get(filling, 0) + n
    return list(done.items())


def bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, and pieces over half a sequence with those that fit beside none."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for k, m in counts.items():
        n[k] = m
    many, long = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    cut = np.arange(half + 1)  # pieces shorter than cut are left out of account
    big = many[-1] - many[capacity - cut]
    mid, mid_long = many[capacity - cut] - many[half], long[capacity - cut] - long[half]
    small = long[half] - np.where(cut > 0, long[np.maximum(cut - 1, 0)], 0)
    more = np.maximum(0, -(-(small - (mid * capacity - mid_long)) // capacity))
    return max(-(-int(long[-1]) // capacity), int((big + mid + more).max()))


class Budget:
    """Steps that a search may take; a step is a node or a filling looked at."""

    def __init__(self, steps: int) -> None:
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(counts: dict[int, int], left: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill ``left``, as a descent by length meets them, while the budget lasts.

    A filling is dominated if more still fits, or if one piece at hand could stand for one or two of its pieces and
    leave less waste.
    """
    sizes = sorted((k for k in counts if k <= left and counts[k]), reverse=True)
    rising = sizes[::-1]

    def dominated(filling: tuple[int, ...], waste: int) -> bool:
        spare = lambda k: counts[k] > filling.count(k)
        for s in {0} | {a for a in filling} | {a + b for i, a in enumerate(filling) for b in filling[i + 1 :]}:
            i = bisect_right(rising, s)
            while i < len(rising) and rising[i] <= s + waste:
                if spare(rising[i]):
                    return True
                i += 1
        return False

    def descend(i: int, filling: tuple[int, ...], left: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        while i < len(sizes) and sizes[i] > left:
            i += 1
        if i == len(sizes) or not left:
            yield left, filling
            return
        size = sizes[i]
        for n in range(min(counts[size], left // size), -1, -1):
            yield from descend(i + 1, filling + (size,) * n, left - n * size)

    for waste, filling in descend(0, (), left):
        if not budget.spend():
            return
        if not dominated(filling, waste):
            yield filling


class Packing(NamedTuple):
    """Patterns, how many sequences they fill, the lower bound, and whether the search ran out of steps before it was done."""

    patterns: list[Pattern]
    sequences: int
    bound: int
    spent: bool


def _branches(open_: dict[int, int], capacity: int, budget: Budget, first: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Around the longest open piece: a whole sequence and how many are filled so, the most that there can be or one.

    Of the first fillings met those with the least waste come first; all others follow as they are met.
    """
    longest = max(open_)
    others = dict(open_)
    others[longest] -= 1
    met = fillings(others, capacity - longest, budget)
    head = sorted(islice(met, first), key=lambda f: (-sum(f), f))
    for filling in chain(head, met) if head else [()]:
        whole = (longest, *filling)
        most = min(open_[k] // whole.count(k) for k in set(whole))
        for times in dict.fromkeys((most, 1)):
            yield whole, times


def pack(counts: dict[int, int], capacity: int, steps: int = 500_000, first: int = 24) -> Packing:
    """Fewest sequences found for ``counts[length]`` pieces of each length.

    Depth first: around the longest open piece come all undominated fillings, lazily. A branch ends when its waste
    leaves no packing better than the incumbent, which at first is the best-fit one. After ``steps`` the incumbent is
    returned and said to be ``spent``; else it is the best there is.
    """
    counts = {k: n for k, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in incumbent), bound(counts, capacity)
    total, budget = sum(k * n for k, n in counts.items()), Budget(steps)
    # what is still open, how it can be gone on with, sequences and waste so far, and the pattern that led here
    stack: list = [(counts, _branches(counts, capacity, budget, first), 0, 0, None)] if fewest > least else []
    while stack and budget.left >= 0 and fewest > least:
        open_, branches, used, waste, _ = stack[-1]
        whole, times = next(branches, ((), 0))
        if not times:
            stack.pop()
            continue
        spare = waste + times * (capacity - sum(whole))
        if not budget.spend() or spare > (fewest - 1) * capacity - total:
            continue
        left = dict(open_)
        for k in whole:
            left[k] -= times
            if not left[k]:
                del left[k]
        if left:
            stack.append((left, _branches(left, capacity, budget, first), used + times, spare, (whole, times)))
        elif used + times < fewest:
            fewest, incumbent = used + times, [step for *_, step in stack if step] + [(whole, times)]
    return Packing(incumbent, fewest, least, fewest > least and budget.left < 0)
