"""Best-fit packing: token pieces of whole documents into as few sequences as bin completion finds.

Method: tasks tokenize and cut; Spark counts the pieces of each length; :mod:`.bin_completion` packs that histogram
(at most ``capacity`` entries) on the driver into patterns; the k-th piece of a length then takes the k-th place that
the patterns have for this length. Ranks come from counts by task and length, so no length is gathered in one place.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import bin_completion, scratch
from .tokens import coder
from .words import released, slices

_log = logging.getLogger(__name__)

#: Tokens of a sequence.
CAPACITY = 2048
#: Id that ends a document.
END = 0


def pieces(docs: DataFrame, tokenizer: str, byte_level: bool = False, end_id: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut the ids of every whole text, and ``end_id``, into pieces of at most ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), the
    ``ids`` themselves if asked for, and (task, rank): the how-manieth piece of its length it is in its task.
    Null text: as empty; an empty text is one piece of the end id. Repeated rows are packed each for itself.
    """
    scratch.small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = schema.replace("doc_id long", f"doc_id {kind}", 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, ranks = coder(tokenizer, byte_level), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids, count = model.encode(data, offsets, end_id)
                n = -(-count // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, count[row] - piece * capacity)
                first = np.cumsum(length) - length
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(first, length, strict=True)]
                rank = np.empty(len(row), dtype=np.int64)
                by = np.argsort(length, kind="stable")
                size = np.bincount(length, minlength=capacity + 1)
                rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ranks, size)
                ranks += size
                columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(released(cut), schema)


def assign(cut: DataFrame, capacity: int = CAPACITY, steps: int = 500_000, report: dict | None = None) -> DataFrame:
    """Give every piece (length, task, rank and more columns) its sequence_id and its offset there.

    ``report`` gets the number of sequences, its lower bound and whether the search ran out of ``steps``; this is logged
    too. An empty table gives an empty table.
    """
    spark = cut.sparkSession
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_task.select("length", "task", before.alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places: dict[int, list[tuple[int, int, int]]] = {}
    filled = dict.fromkeys(counts, 0)
    sequence = 0
    found = bin_completion.pack(counts, capacity, steps)
    _log.info("%d sequences, no fewer than %d%s", found.sequences, found.bound, ", the search ran out of steps" * found.spent)
    if report is not None:
        report |= {"sequences": found.sequences, "bound": found.bound, "spent": found.spent}
    for pattern, times in found.patterns:
        offset = 0
        for length in pattern:
            places.setdefault(length, []).append((filled[length], sequence, offset))
            filled[length] += times
            offset += length
        sequence += times
    table = {k: np.array(v, dtype=np.int64) for k, v in places.items()}  # as large as the patterns, not as the corpus
    shared = spark.sparkContext.broadcast(table)
    numbered = cut.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    names = numbered.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                at = shared.value[int(k)]
                slot = np.searchsorted(at[:, 0], rank[own], side="right") - 1
                seq[own] = at[slot, 1] + rank[own] - at[slot, 0]
                off[own] = at[slot, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long").drop("rank")


def packed(docs: DataFrame, tokenizer: str, byte_level: bool = False, end_id: int = END, capacity: int = CAPACITY, with_ids: bool = False, report: dict | None = None) -> DataFrame:
    """Pack whole documents (doc_id, text): see :func:`pieces` and :func:`assign`. Other columns do not matter."""
    with scratch.steps(docs.sparkSession):
        cut = scratch.keep(pieces(docs, tokenizer, byte_level, end_id, capacity, with_ids), "pieces", stay=True)
    return assign(cut, capacity, report=report)


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_packing``: all documents into sequences of 2048 tokens."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
