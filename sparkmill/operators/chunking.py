"""Token-budgeted chunks of a document's lines with suffix overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkmill.functions.markdown import clean_lines, lines, looks_like_heading
from sparkmill.functions.text import strip


def packed(lines: list[str], budget: int, overlap: int, tokens: Callable[[str], int | None]) -> list[str]:
    """CHK03, CHK04: lines greedily to chunks of at most ``budget`` tokens; each chunk begins with the longest suffix of the last one that has at most ``overlap``.

    A line of its own that is longer is a chunk by itself; lines that cannot be counted are left out.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for line in lines:
        n = tokens(line)
        if n is None:
            continue
        if held and sum(k for _, k in held) + n > budget:
            out.append(" ".join(x for x, _ in held))
            keep, start = 0, len(held)
            while start and keep + held[start - 1][1] <= overlap:
                start -= 1
                keep += held[start][1]
            held = held[start:]
        held.append((line, n))
    return out + [" ".join(x for x, _ in held)] * bool(held)


def words(line: str) -> int:
    """CHK02: words, in place of a model's tokens."""
    return len(line.split())


def cut_up(docs: DataFrame, source: Column, cut: Callable[[object], list[str]]) -> DataFrame:
    """The columns of documents but ``text``, with (segment, chunk): what ``cut`` makes of a column, in order.

    The other columns pass as Arrow arrays, so ids of any type, null ones and large numbers, stay what they are. Names
    that are there already as segment or chunk are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "segment", "chunk")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(x) for x in batch.column(len(kept)).to_pylist()]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            columns = [c.take(row) for c in batch.columns[:-1]]
            segment, chunk = pa.array([k for f in found for k in range(len(f))], pa.int32()), pa.array([x for f in found for x in f], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, segment, chunk], names=[*kept, "segment", "chunk"])

    rows = docs.select(*kept, source.alias("__source"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}{', ' if kept else ''}segment int, chunk string")


def chunked(docs: DataFrame, most: int = 512, overlap_ratio: float = 0.1, tokens: Callable[[str], int | None] = words) -> DataFrame:
    """WIN03, WIN11, CHK03, CHK05: the columns of documents but ``text``, with (segment, chunk); the budget is four fifths of ``most``.

    Documents stay in their tasks; only clean lines go to Python, a batch at a time. A ratio of 0 means no overlap.
    Null, empty and blank texts have no chunks; every row of a repeated id has its own.
    """
    budget = int(0.8 * most)
    overlap = max(1, int(budget * overlap_ratio)) if overlap_ratio > 0 else 0
    return cut_up(docs, clean_lines(F.col("text")), lambda lines: packed(lines, budget, overlap, tokens))


def windows(tokens, size: int, overlap: int):
    """CHK06: fixed windows over an array column of tokens."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - overlap - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(size)), " "))


def sections(docs: DataFrame, heading: Callable[[Column], Column] = looks_like_heading) -> DataFrame:
    """CHK09: (doc_id, section, title, text): a heading line begins a section; what stands before the first is the preamble.

    Sections count from 0 or, where the first line is a heading, from 1; those without a text are left out. Rows that
    share a doc_id, null too, are documents of their own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", lines(F.col("text")).alias("lines"))
    rows = rows.select("__row", "doc_id", F.posexplode("lines").alias("at", "line")).withColumn("head", heading(F.col("line")))
    rows = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(Window.partitionBy("__row").orderBy("at")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    title = F.coalesce(F.max(F.when(F.col("head"), strip(F.col("line")))), F.lit("Preámbulo"))
    out = rows.groupBy("__row", "doc_id", "section").agg(title.alias("title"), strip(body).alias("text"))
    return out.where("text != ''").select("doc_id", "section", "title", "text")
