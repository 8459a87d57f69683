"""The Spark-free helpers against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sparkmill.llm import bin_completion, huffman, op3_ngram_join as op3, op5_quality as op5, words
from sparkmill.llm.fm_index import FMIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {"spaced": r"[^\x20\x09-\x0D]+", "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ9 \n\t.éß漢\x1f", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_runs(texts):
    for kind, pattern in PATTERNS.items():
        plain = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        seen: dict[int, str] = {}
        at = 0
        for lo, hi, data, offsets in words.slices(pa.array(texts, pa.string()), most=16):
            assert lo == at
            starts, ends, first = words.bounds(data, offsets, kind)
            assert [bytes(data[a:b]).decode().translate(LOWER) for a, b in zip(starts, ends)] == [w for t in plain[lo:hi] for w in t]
            h = words.hashes(data, starts, ends)
            for x, w in zip(h.tolist(), (w for t in plain[lo:hi] for w in t)):
                assert seen.setdefault(x, w) == w
            for r, t in zip(words.runs(h, first, 3), plain[lo:hi]):
                assert len(r) == (max(1, len(t) - 2) if t else 0)
            at = hi
        assert at == len(texts)


def test_fm_index_against_scanning():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 1), (50, 2), (400, 5), (300, 200)):
        s = rng.integers(1, sigma + 1, n)
        index = FMIndex(s)
        for length in (1, 2, 5):
            patterns = rng.integers(1, sigma + 2, (30, length))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(n - length + 1) if (s[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_fm_index_of_one_repeated_symbol():
    index = FMIndex(np.ones(3000, dtype=np.int64))
    low, high = index.search(np.ones((1, 7), dtype=np.int64))
    assert high[0] - low[0] == 2994


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(0, 3))
def test_huffman_round_trip(ids, power):
    ids = np.array([i**power if power else i for i in ids], dtype=np.int64) % 50_000
    counts = np.bincount(ids, minlength=50_001)
    lengths = huffman.code_lengths(counts)
    table = huffman.codes(lengths)
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    bits, marks = huffman.encode(ids, lengths, table)
    assert (huffman.decode(bits, marks, len(ids), *huffman.decode_table(lengths, table)) == ids).all()


def test_huffman_limit_and_optimum():
    counts = np.array([2**i for i in range(30)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) <= 1
    free = huffman.code_lengths(np.array([5, 9, 12, 13, 16, 45]))
    assert int((free * np.array([5, 9, 12, 13, 16, 45])).sum()) == 224


def fewest(items: list[int], capacity: int) -> int:
    best = len(items)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in sorted(set(range(len(bins)))):
            if bins[b] + items[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        got = bin_completion.pack(dict(Counter(items)), 20).patterns
        assert sorted((k for p, n in got for k in p for _ in range(n)), reverse=True) == items
        assert all(sum(p) <= 20 for p, _ in got)
        assert sum(n for _, n in got) == fewest(items, 20)
        assert bin_completion.bound(dict(Counter(items)), 20) <= fewest(items, 20)


def test_bin_completion_beats_best_fit():
    counts = dict(Counter([5, 4, 4, 3, 2, 2]))
    assert sum(n for _, n in bin_completion.best_fit(counts, 10)) == 3
    assert sum(n for _, n in bin_completion.pack(counts, 10).patterns) == 2
    assert bin_completion.pack({}, 10) == ([], 0, 0, False)


def test_bin_completion_says_when_its_steps_ran_out():
    counts = {20: 1, 21: 1, 27: 1, 28: 1, 31: 1, 32: 2, 35: 2, 44: 2, 45: 1, 47: 2, 51: 1, 58: 1, 61: 2, 62: 2, 65: 1, 69: 1, 71: 1, 72: 1, 76: 1, 78: 1, 82: 2, 83: 1, 84: 3, 85: 3, 87: 1, 90: 1, 97: 1, 100: 1, 103: 1}
    found = bin_completion.pack(counts, 150)
    assert found.sequences == sum(n for _, n in found.patterns) and found.bound == 17
    assert found.sequences == 17 or found.spent
    short = bin_completion.pack(counts, 150, steps=50)
    assert short.spent and short.sequences >= found.sequences
    whole = {k: sum(f.count(k) * n for f, n in found.patterns) for k in counts}
    assert whole == counts and all(sum(f) <= 150 for f, _ in found.patterns)


def test_bitmap_never_excludes_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)
        other = np.union1d(base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        base = np.unique(base)
        common = len(np.intersect1d(base, other))
        if 100 * common >= 75 * (len(base) + len(other) - common):
            differ = sum(bin(int(a) & (2**64 - 1)).count("1") for a in np.bitwise_xor(op3._bitmap(base), op3._bitmap(other)))
            assert 175 * differ <= 25 * (len(base) + len(other))


def test_wider_bitmap_never_excludes_a_link_and_tells_large_sets_apart():
    rng = np.random.default_rng(6)
    rows, want = [], []
    for size in (1100, 2040, 2060, 5000):
        for kept in (1.0, 0.9, 0.88, 0.87, 0.8, 0.0):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            other = np.union1d(base[: int(kept * size)], rng.integers(0, 2**63, size // 20 if kept else size, dtype=np.uint64))
            common = len(np.intersect1d(base, other))
            want.append((100 * common >= 75 * (len(base) + len(other) - common), common))
            rows.append((len(base) + len(other), op3._wide(base), op3._wide(other)))
    assert op3._wide(np.arange(1024, dtype=np.uint64)) is None
    ids = pa.array(range(len(rows)), pa.int64())
    n, x, y = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(n, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b", "n", "x", "y"])
    left = {i for out in op3._wide_match(iter([batch])) for i in out.column(0).to_pylist()}
    assert {i for i, (link, _) in enumerate(want) if link} <= left
    assert not left & {i for i, (_, common) in enumerate(want) if not common}


def brute_kneser_ney(texts: list[str]):
    """Interpolated modified Kneser-Ney over tuples, straight from its definition."""
    top = Counter()
    for t in texts:
        s = [0, 0, 0] + [ord(c) for c in t]
        top.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    levels = {4: top}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def prob(g: tuple) -> float:
        if not g:
            return 1 / 0x110000
        c = levels[len(g)]
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else y for i in (1, 2, 3)]
        d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(raw, 1)]
        cut = lambda v: d[min(v, 3) - 1]
        same = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return prob(g[1:])
        own = same[g] - cut(same[g]) if g in same else 0.0
        return own / total + sum(cut(v) for v in same.values()) / total * prob(g[1:])

    return prob


def brute_perplexity(prob, text: str) -> float:
    s = [0, 0, 0] + [ord(c) for c in text]
    return float(np.exp(-np.mean([np.log(prob(tuple(s[i : i + 4]))) for i in range(len(s) - 3)])))


@pytest.mark.parametrize("small", [False, True])
def test_kneser_ney_against_its_definition(spark, monkeypatch, small):
    taught, others = ["abra cadabra", "abra abra", "cad bra", "a", "ac dc", "Ωμέγα 漢"], ["abra", "bad cab", "zzz a", "漢字 καὶ", "", None]
    if small:  # no broadcast; runs are passed on at once
        monkeypatch.setattr(op5, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(op5, "HELD_RUNS", 1)
    texts = spark.createDataFrame([(i, t, i < len(taught)) for i, t in enumerate(taught + others)], "row long, text string, taught boolean")
    runs = op5.gathered(texts).cache()
    got = {r["row"]: r for r in op5.perplexities(texts, op5.kneser_ney(runs)).collect()}
    prob = brute_kneser_ney([t.lower() for t in taught])
    for i, text in enumerate(taught + others):
        if text:
            assert got[i]["perplexity"] == pytest.approx(brute_perplexity(prob, text.lower()), rel=1e-9) and got[i]["n"] == len(text)
        else:
            assert i not in got


def test_counted_runs_with_many_symbols_and_long_texts():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 0x110000, 3000).astype(np.uint32)
    row = np.repeat(np.arange(3, dtype=np.int32), 1000)
    for values in (c, c % 5 + 97, np.full(3000, 97, np.uint32)):
        at, runs, n = op5._counted(values, row, np.arange(3))
        want = Counter()
        for r in range(3):
            s = [0, 0, 0, *values[row == r].tolist()]
            want.update((r, *s[i : i + 4]) for i in range(1000))
        assert Counter({(int(a), *map(int, x)): int(k) for a, x, k in zip(at, runs.T, n, strict=True)}) == want

