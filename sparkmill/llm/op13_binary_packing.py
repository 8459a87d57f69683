"""Packing by power-of-two decomposition: every document becomes pieces of binary lengths, every piece a sequence of its own.

Method: a task tokenizes whole texts; a document of n tokens gives n div ``capacity`` full pieces and then one piece for
each binary digit of the rest, the longest first. A piece is a sequence, so no sequence crosses documents, and as its
length is a power of two none needs padding. :func:`batches` then gathers equal lengths. There is no shuffle: numbers of
sequences come from the partition and the place in it, and a lost executor's partitions give the same pieces again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import coder
from .words import released, slices

#: Tokens of the longest sequence, a power of two.
CAPACITY = 1024
#: Id that ends a document.
END = 0
#: Tokens of a batch of equal lengths.
BATCH_TOKENS = 1 << 16


def decomposed(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces of documents with so many tokens, in order."""
    full, rest = counts // capacity, counts % capacity
    row = np.repeat(np.arange(len(counts)), full)
    rows, starts, lengths = [row], [(np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)) * capacity], [np.full(len(row), capacity)]
    for bit in range(capacity.bit_length() - 1):
        own = np.flatnonzero(rest >> bit & 1)
        rows.append(own)
        starts.append(full[own] * capacity + (rest[own] >> (bit + 1) << (bit + 1)))
        lengths.append(np.full(len(own), 1 << bit))
    row, start, length = (np.concatenate(x) for x in (rows, starts, lengths))
    order = np.lexsort((start, row))
    return row[order], start[order], length[order]


def sequences(docs: DataFrame, tokenizer: str, byte_level: bool = True, end_id: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut the ids of every whole text (doc_id, text; other columns do not matter), and ``end_id``, into sequences.

    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens (with
    the end id), sequence_id, offset (always 0) and, if asked for, the ``ids``. Null text: as empty; an empty text is one
    sequence of the end id. Null doc_ids stay null, repeated rows are cut each for itself, an empty table gives an
    empty table. A long text is encoded in parts, its sequences leave the task a batch at a time.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"a capacity of {capacity} is no power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = coder(tokenizer, byte_level)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                ids, count = model.encode(data, offsets, end_id)
                row, start, length = decomposed(count, capacity)
                raw, first = ids.astype("<u4"), np.cumsum(length) - length
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(count[row])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(released(cut), schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def batches(cut: DataFrame, tokens: int = BATCH_TOKENS) -> DataFrame:
    """Sequences with their ids as batches of equal lengths: (length, sequence_ids, ids), the ids one after another.

    Each task fills its own batches, of ``tokens`` div length sequences (one at least); its last one of a length may hold fewer. A task holds
    one open batch a length. An empty table gives an empty table.
    """

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def full(length: int) -> pa.RecordBatch:
            own = held.pop(length)
            columns = [pa.array([length], pa.int64()), pa.array([[s for s, _ in own]], pa.list_(pa.int64())), pa.array([np.concatenate([x for _, x in own])], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["length", "sequence_ids", "ids"])

        for batch in rows:
            for length, name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(length, []).append((name, ids.values.to_numpy(zero_copy_only=False).copy()))
                if len(held[length]) >= max(1, tokens // length):
                    yield full(length)
        for length in sorted(held):
            yield full(length)

    return cut.select("length", "sequence_id", "ids").mapInArrow(gather, "length long, sequence_ids array<long>, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    """``op13_binary_packing``: all documents into sequences of binary lengths up to 1024."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sequences(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
