"""Benchmark decontamination: an FM-index of every training shard, searched for all windows of the test items.

Method: each task indexes its shards of whole texts (:mod:`.fm_index`), finds the items' windows by backward
search, locates the occurrences by sampled suffix positions and merges them into spans. Words that no item holds
cannot be part of an occurrence, so the index keeps only runs of item words that are long enough for the shortest
window; this changes no result. Documents are not shuffled; the items travel to the tasks in blocks of a checked size.
Each block is searched in the whole texts; the hit words are carried from block to block and counted or cut at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import scratch, words
from .fm_index import FMIndex

#: Words of a window.
WINDOW = 10
#: Bytes of text in one index.
SHARD_BYTES = 1 << 21
#: Bytes of item texts that go to the tasks at once (their windows some 12 times that); more items take further passes over the documents.
ITEM_BYTES = 8 << 20
#: Column of the hit words of earlier blocks of items.
SPANS = "__hit_spans"


class _Items:
    """The windows of a block of items, as symbols of their own words.

    For each window length: ``windows``, one a row, and their items, those of window w from ``begins[w]`` to
    ``begins[w + 1]`` in ``owners``. Arrays throughout: a block takes some 12 times the bytes of its texts.
    """

    def __init__(self, rows: list[tuple[str, str]], k: int) -> None:
        column = pa.array([t for _, t in rows], pa.large_string())
        self.ids = [i for i, _ in rows]
        every, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in words.slices(column):
            starts, ends, first = words.bounds(data, offsets, "alnum")
            every.append(words.hashes(data, starts, ends))
            size.append(np.diff(first))
        h, size = np.concatenate(every), np.concatenate(size)
        self.vocabulary, symbols = np.unique(h, return_inverse=True)
        symbols = (symbols + 2).astype(np.int32)
        begin = np.cumsum(size) - size
        self.windows, self.begins, self.owners = {}, {}, {}
        for length in np.unique(np.minimum(size, k)):
            if not length:
                continue
            items = np.flatnonzero(np.minimum(size, k) == length)
            n = size[items] - length + 1
            item = np.repeat(items, n)
            at = np.repeat(begin[items] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.zeros(len(at), dtype=np.uint64)
            for j in range(length):
                key = words.mix(key + h[at + j])
            _, first, window = np.unique(key, return_index=True, return_inverse=True)
            pairs = np.unique(window * len(rows) + item)
            self.windows[int(length)] = symbols[at[first][:, None] + np.arange(length)]
            self.begins[int(length)] = np.searchsorted(pairs, np.arange(len(first) + 1) * len(rows))
            self.owners[int(length)] = (pairs % len(rows)).astype(np.int32)
        self.shortest = min(self.windows, default=0)

    def owned(self, length: int, window: int) -> list[int]:
        begins = self.begins[length]
        return self.owners[length][begins[window] : begins[window + 1]].tolist()


def _occurrences(items: _Items, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(window length, window, word numbers at which it occurs)`` for one shard."""
    if not len(h) or not items.shortest:
        return
    at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    known = items.vocabulary[at] == h
    cut = np.zeros(len(h) + 1, dtype=bool)
    cut[first] = True
    begins = known & (~np.append(False, known[:-1]) | cut[:-1])
    stops = known & (~np.append(known[1:], False) | cut[1:])
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = b - a >= items.shortest
    a, b = a[long], b[long]
    if not len(a):
        return
    n = b - a + 1  # and a separator
    text = np.ones(int(n.sum()), dtype=np.int64)
    origin = np.full(len(text), -1, dtype=np.int64)
    start = np.cumsum(n) - n
    within = np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    origin[np.repeat(start, b - a) + within] = np.repeat(a, b - a) + within
    text[origin >= 0] = at[origin[origin >= 0]] + 2
    index = FMIndex(text)
    for length, windows in items.windows.items():
        low, high = index.search(windows)
        for w in np.flatnonzero(high > low):
            yield length, w, origin[index.locate(np.arange(low[w], high[w]))]


def _shard(items: _Items, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[int]], tuple]:
    """Per row: number of words; per word: whether it is hit; per row: the items that occur; and the words' bounds."""
    starts, ends, first = words.bounds(data, offsets, "alnum")
    h = words.hashes(data, starts, ends)
    change = np.zeros(len(h) + 1, dtype=np.int64)
    inside: list[set[int]] = [set() for _ in first[1:]]
    for length, w, at in _occurrences(items, h, first):
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        for row in np.unique(np.searchsorted(first, at, side="right") - 1):
            inside[row].update(items.owned(length, w))
    return np.diff(first), np.cumsum(change)[:-1] > 0, inside, (starts, ends, first)


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """``(items, whether more follow)``, a block of about ``ITEM_BYTES`` of text at a time; at least one block."""
    known = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = known.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = 1 + int(total) // ITEM_BYTES
    for i in range(n):
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.toLocalIterator()], i + 1 < n


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, clean: bool = False) -> DataFrame:
    """Find (and with ``clean`` remove) passages of ``docs`` that hold a window of ``items``.

    docs: doc_id, text and any more columns; items: item_id, text. Words are runs of ASCII letters, digits and
    non-ASCII characters, A-Z lowered. A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.

    Without ``clean``: doc_id, n_words, n_hit (words inside any occurrence), items (array of ids as strings, sorted);
    other columns do not matter. With ``clean``: the columns of docs, the merged spans cut out of ``text`` from the
    first hit word to the end of the last, texts without hits as they were.

    Null or empty text: no words, no hits (``clean`` keeps the null). Items without words, null items or an empty
    table: no hits. Repeated rows and ids: a result for each row of docs; item ids count once.
    """
    source = docs if clean else docs.select("doc_id", "text", F.lit(0).alias("n_words"), F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items"))
    names = source.columns
    scratch.small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    out = source
    for block, more in _blocks(items):
        shared = context.broadcast(_Items(block, window))
        held = list(out.columns)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, more=more, held=held) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                column = batch.column(held.index("text"))
                for lo, hi, data, offsets in words.slices(column, SHARD_BYTES):
                    part = batch.slice(lo, hi - lo)
                    n, hit, inside, (starts, ends, first) = _shard(known, data, offsets)
                    if SPANS in held:
                        hit = hit | _hits(part.column(held.index(SPANS)), first)
                    fields = {}
                    if more:
                        fields[SPANS] = _spans(hit, first)
                    elif clean:
                        fields["text"] = _cut(part.column(held.index("text")), data, offsets, hit, starts, ends, first)
                    else:
                        before = np.concatenate([[0], np.cumsum(hit)])
                        fields["n_words"] = pa.array(n, pa.int32())
                        fields["n_hit"] = pa.array(before[first[1:]] - before[first[:-1]], pa.int32())
                    if not clean:
                        had = part.column(held.index("items")).to_pylist()
                        fields["items"] = pa.array([sorted({*(a or ()), *(known.ids[i] for i in b)}) for a, b in zip(had, inside, strict=True)], pa.list_(pa.string()))
                    to = [*names, SPANS] if more else names
                    yield pa.RecordBatch.from_arrays([fields[c] if c in fields else part.column(held.index(c)) for c in to], names=to)

        schema = T.StructType([*source.schema.fields, T.StructField(SPANS, T.ArrayType(T.IntegerType()))]) if more else source.schema
        out = out.mapInArrow(words.released(search), schema)
        if more:  # the block's work is done before the next one is loaded
            out = scratch.keep(out, "hit-spans", stay=True)
            shared.destroy()
    return out if clean else out.drop("text")


def _spans(hit: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per row the numbers, within the row, of the words at which runs of hit words begin and end, in turn."""
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        inside = np.concatenate([[False], hit[a:b], [False]])
        out.append(np.flatnonzero(inside[1:] != inside[:-1]))
    return pa.array(out, pa.list_(pa.int32()))


def _hits(spans: pa.Array, first: np.ndarray) -> np.ndarray:
    """What :func:`_spans` has written, as one flag a word."""
    change = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    for a, edges in zip(first[:-1], spans.to_pylist(), strict=True):
        np.add.at(change, a + np.array(edges[::2], dtype=np.int64), 1)
        np.add.at(change, a + np.array(edges[1::2], dtype=np.int64), -1)
    return np.cumsum(change)[:-1] > 0


def _cut(column: pa.Array, data: np.ndarray, offsets: np.ndarray, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    before = np.concatenate([[0], np.cumsum(hit)])
    touched = np.flatnonzero(before[first[1:]] > before[first[:-1]])
    if not len(touched):
        return column
    texts = column.to_pylist()
    for row in touched:
        a, b = first[row], first[row + 1]
        inside = np.concatenate([[False], hit[a:b], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        keep, at = [], int(offsets[row])
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            keep.append(data[at : starts[a + s]].tobytes())
            at = int(ends[a + e - 1])
        keep.append(data[at : offsets[row + 1]].tobytes())
        texts[row] = b"".join(keep).decode()
    return pa.array(texts, column.type)


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_decontamination``: every document against every benchmark item."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), g as (
    select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') t
    from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, least(1, len(w))))) i from b)
), sizes as (select distinct n from g)
, o as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') t
    from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, sizes where len(w) >= n)
), f as (select o.doc_id, o.i, o.n, g.item_id from o join g using (n, t))
, h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from f) group by doc_id)
, m as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item_id::varchar item from f) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join m using (doc_id)
"""
