"""Token-id files: canonical length-limited Huffman codes of all documents in ascending doc_id order.

The file is a folder of two tables, so that any store Spark reaches can hold it. ``header``: one row with the format's
name, the code length of every id and the number of ids before each part. ``blocks``: one row a block of whole
documents with its packed codes and, for every 64th id, its bit offset; each block decodes alone.

Method: tasks tokenize whole texts and deal them to parts by doc_id quantiles; a first table holds the ids in order,
Spark sums the counts of each id, the codes come from these at most 65,536 sums, and a second pass encodes the blocks.
Only one row a block and one sum a part leave the tasks; no id stream passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import huffman, scratch
from .tokens import coder
from .words import slices

#: Id that ends a document.
END = 2
#: Ids of a block, more only if its one document has more.
BLOCK_IDS = 1 << 18
FORMAT = "huffman-ids-1"
_IDS = "part int, block int, before long, doc_ids array<long>, counts array<long>, ids binary"
_BLOCKS = "part int, block int, before long, doc_ids array<long>, counts array<long>, n long, bits binary, checkpoints binary"


def _tokenized(docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int, edges: list[int]) -> DataFrame:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, press = coder(tokenizer, byte_level), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                flat, count = model.encode(data, offsets, end_id)
                raw, end = flat.astype("<u4" if model.model.get_vocab_size() > 1 << 16 else "<u2"), np.cumsum(count)
                doc = part.column(0).cast(pa.int64())
                where = np.searchsorted(np.array(edges, dtype=np.int64), doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), doc, pa.array(count), pa.array([press.compress(raw[a:b]) for a, b in zip(end - count, end, strict=True)], pa.binary())], names=["part", "doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(ids, "part int, doc_id long, n long, ids binary")


def _blocks(width: str):
    """Consecutive documents of a part into blocks; the rows come sorted."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        part, block, before, held, docs, counts, data = None, 0, 0, 0, [], [], []

        def row() -> pa.RecordBatch:
            values = [part, block, before, docs, counts, press.compress(b"".join(data))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=[f.split()[0] for f in _IDS.split(", ")])

        for batch in batches:
            for p, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and (p != part or held + n > BLOCK_IDS):
                    yield row()
                    block, before, held, docs, counts, data = block + 1, before + held, 0, [], [], []
                if p != part:
                    part, block, before = p, 0, 0
                docs.append(doc)
                counts.append(n)
                data.append(open_.decompress(ids))
                held += n
        if docs:
            yield row()

    return gather


def write(docs: DataFrame, path: str, tokenizer: str, byte_level: bool = True, end_id: int = END) -> None:
    """Encode every whole text (doc_id, text; other columns do not matter) to the folder ``path``.

    Null text: as empty, just the end id. Null doc_ids come first. Rows with one doc_id stand next to each other, the
    shorter first. An empty table gives a file without blocks.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 100 * parts)).head()[0] if parts > 1 else []
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    vocabulary = max(vocabulary, end_id + 1)
    width = "<u4" if vocabulary > 1 << 16 else "<u2"
    dealt = _tokenized(docs, tokenizer, byte_level, end_id, sorted(set(edges or []))).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "ids")
    held = scratch.fresh(spark, "ids")
    dealt.mapInArrow(_blocks(width), _IDS).write.option("compression", "none").parquet(held)
    ids = spark.read.schema(_IDS).parquet(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, press = np.zeros(vocabulary, dtype=np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(press.decompress(raw), width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    sums = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id there is
    totals = np.zeros(vocabulary, dtype=np.int64)
    for r in sums:
        totals[r["id"]] = r["n"]
    lengths = huffman.code_lengths(totals)
    table = huffman.codes(lengths)
    shared = spark.sparkContext.broadcast((lengths, table))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, raw in enumerate(batch.column(5).to_pylist()):
                flat = np.frombuffer(press.decompress(raw), width)
                bits, marks = huffman.encode(flat, *shared.value)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:5], pa.array([len(flat)], pa.int64()), pa.array([bits], pa.binary()), pa.array([marks], pa.binary())], names=[f.split()[0] for f in _BLOCKS.split(", ")])

    ids.mapInArrow(encode, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(spark, held)
    sizes = {r["part"]: r["n"] for r in spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a part
    before, base = 0, []
    for p in range(max(sizes, default=-1) + 1):
        base.append(before)
        before += sizes.get(p, 0)
    spark.createDataFrame([(FORMAT, bytes(lengths), base)], "format string, code_lengths binary, before array<long>").coalesce(1).write.parquet(f"{path}/header")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a file: doc_id, start (ids of all documents before it), n_tokens and ids; with ``digest`` the crc32 of the ids as little-endian unsigned 32-bit integers, ``ids_crc32``, in their place."""
    head = spark.read.parquet(f"{path}/header").head()
    if head["format"] != FORMAT:
        raise ValueError(f"{path} holds {head['format']}, not {FORMAT}")
    lengths = np.frombuffer(bytes(head["code_lengths"]), dtype=np.uint8)
    shared = spark.sparkContext.broadcast((lengths, huffman.codes(lengths), np.array(head["before"], dtype=np.int64)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, table, base = shared.value
        symbol, size = huffman.decode_table(lengths, table)
        for batch in batches:
            for k in range(batch.num_rows):
                part, _, before, docs, counts, n, bits, marks = (c[k] for c in batch.columns)
                ids = huffman.decode(bits.as_py(), marks.as_py(), n.as_py(), symbol, size)
                count = counts.values.to_numpy(zero_copy_only=False)
                end = np.cumsum(count)
                start = base[part.as_py()] + before.as_py() + end - count
                if digest:
                    raw = ids.astype("<u4")
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(end - count, end, strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(start), pa.array(count), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_token_file``: writes all documents and reads the file back."""
    import public_tokenizers

    path = scratch.fresh(spark, "token-file")
    scratch.leave(path)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path, digest=True)
