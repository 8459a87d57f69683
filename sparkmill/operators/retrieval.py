"""Retrieval over embedded chunks: exact cosine, filters, relaxation, ranking and context assembly.

Ranks are limited before the shuffle, by tasks or by Spark's window group limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkmill.functions.text import kind as kind_of

#: Queries that go to the corpus at once, and how many of them are compared at once with how many rows of it.
BLOCK, ASKED, ROWS = 16_384, 1_024, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """MTH04: raw cosine in double precision; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def clamped(score: Column) -> Column:
    """MTH02: within 0 and 1, six decimals."""
    return F.when(score < 0, 0.0).when(score > 1, 1.0).otherwise(F.round(score, 6))


def similarity(a: Column, b: Column) -> Column:
    """MTH01: cosine within 0 and 1, 0 for a zero vector."""
    return clamped(F.coalesce(cosine(a, b), F.lit(0.0)))


def search(queries: DataFrame, corpus: DataFrame, k: int, same_tag: bool = False) -> DataFrame:
    """SRT01, JOI10: the k nearest rows (id, v) of the corpus to each query (qid, q): qid, id, score.

    The queries go to the corpus in blocks of ``BLOCK``, so what is broadcast has a bound however many there are, and
    the corpus is read once a block; inside a task ``ASKED`` of them meet ``ROWS`` rows at once. Each task keeps its own k best of each query; Spark ranks those. With ``same_tag``
    both tables have a ``tag`` and only rows of the query's tag count. Zero and null vectors are found by nothing, nor
    are vectors of another length than the query's; a block may hold several lengths. Rows without an id, and queries
    without one, are left out; ids are numbers or texts. Ties go to the lower id.
    """
    spark = corpus.sparkSession
    tag = F.col("tag").cast("string") if same_tag else F.lit("")
    asked = queries.select("qid", "q", tag.alias("tag")).where("q is not null and qid is not null")
    rows = corpus.select("id", "v", tag.alias("tag")).where("v is not null and id is not null")
    of = {c: t.schema[c].dataType.simpleString() for t, c in ((asked, "qid"), (rows, "id"))}
    last = "\U0010ffff" if of["id"] == "string" else np.iinfo(np.int64).max  # after all others
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for i in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        block = own.toPandas()
        shared = spark.sparkContext.broadcast((block["qid"].to_numpy(), _by_length(block["q"]), block["tag"].to_numpy()))

        def nearest(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, by_length, tags = shared.value
            ids, scores = np.full((len(qid), k), last), np.full((len(qid), k), -np.inf)
            for batch in batches:
                for at in range(0, len(batch) if len(qid) else 0, ROWS):
                    part = batch.iloc[at : at + ROWS]
                    for n, (there, v) in _by_length(part["v"]).items():
                        if n not in by_length:
                            continue
                        asks, q = by_length[n]
                        names = part["id"].to_numpy()[there]
                        names = names.astype(str) if isinstance(last, str) else names
                        for lo in range(0, len(asks), ASKED):
                            own = asks[lo : lo + ASKED]
                            score = np.nan_to_num(q[lo : lo + ASKED] @ v.T, nan=-np.inf)
                            if same_tag:
                                score[tags[own][:, None] != part["tag"].to_numpy()[there][None, :]] = -np.inf
                            ids = _better(ids, scores, own, names, score)
            row, col = np.nonzero(scores > -np.inf)
            yield pd.DataFrame({"qid": qid[row], "id": ids[row, col], "score": scores[row, col]})

        part = rows.mapInPandas(nearest, f"qid {of['qid']}, id {of['id']}, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k).drop("ranking")


def _better(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, new_ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Take the new scores (a row for each query in ``own``) that are among its best into ``scores``, best first; the ids that go with them are returned."""
    some = np.flatnonzero((new >= scores[own, -1][:, None]).any(axis=1) & (new > -np.inf).any(axis=1))
    if len(some):
        at = own[some]
        both = np.concatenate([scores[at], new[some]], axis=1)
        names = np.concatenate([ids[at], np.broadcast_to(new_ids, (len(some), len(new_ids)))], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : ids.shape[1]]
        ids = ids.astype(names.dtype, copy=False)  # texts may be longer now
        scores[at], ids[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
    return ids


def _by_length(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the places of its vectors and these as unit rows in double precision; NaN for a zero vector."""
    x = [np.asarray(v, dtype=np.float64) for v in vectors]
    out = {}
    for n in {len(v) for v in x}:
        there = np.array([i for i, v in enumerate(x) if len(v) == n])
        rows = np.stack([x[i] for i in there])
        norm = np.linalg.norm(rows, axis=1)
        out[n] = there, rows / np.where(norm > 0, norm, np.nan)[:, None]
    return out


def top_k(hits: DataFrame, k: int | Column) -> DataFrame:
    """SRT01, WIN01: the k best hits of each query, ranked from 1; ties by id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return hits.withColumn("ranking", rank).where(F.col("ranking") <= k)


def above(hits: DataFrame, threshold: float | None) -> DataFrame:
    """FLT03: hits strictly above the threshold; all of a query's hits if none is; no threshold keeps all."""
    if threshold is None:
        return hits
    ok = F.col("score") > threshold
    return hits.withColumn("__any", F.max(ok).over(Window.partitionBy("qid"))).where(ok | ~F.col("__any")).drop("__any")


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """FLT01: rows equal in all keys; null and empty values do not filter."""
    used = {k: v for k, v in wanted.items() if v is not None and v != ""}
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in used.items()), F.lit(True)))


def relaxed(hits: DataFrame, wanted: Column) -> DataFrame:
    """FLT04: a query's hits that match; all of them if none does."""
    any_ = F.max(F.coalesce(wanted, F.lit(False))).over(Window.partitionBy("qid"))
    return hits.withColumn("__any", any_).where(wanted | ~F.col("__any")).drop("__any")


def context(hits: DataFrame) -> DataFrame:
    """STR18, AGG31: the ranked chunks of each query as one context text."""
    block = F.format_string('[CHUNK #%d | score=%.6f | file=%s | seg=%d]\n"""%s"""', "ranking", "score", "file", "segment", "text")
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ranking", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))


def best(hits: DataFrame) -> DataFrame:
    """SRT03: each query's best hit."""
    return hits.groupBy("qid").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("best")).select("qid", "best.id", "best.score")


def finite(score: Column) -> Column:
    """PRJ01: a score that can be shown; 0 for null, NaN and infinite ones."""
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def history_order(name: str) -> list[Column]:
    """SRT04: the columns of one of four orders; any other name is the latest first."""
    orders = {"date_asc": [F.asc("ts")], "time_desc": [F.desc("seconds")], "time_asc": [F.asc("seconds")]}
    return orders.get(name, [F.desc("ts")])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SRT05: a page's rows; numbers outside 1 to the last page are brought inside."""
    n = df.count()
    number = min(max(1, number), max(1, -(-n // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_as_asked(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SRT06: a page's rows; pages below 1 are the first, one after the last is empty."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after(df: DataFrame, key: str, last: object, size: int) -> DataFrame:
    """SRC12, WIN10: the next ``size`` rows by key after the last one seen; None begins. The key's filter reaches the scan."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)


def scrolled(df: DataFrame, order: list[Column], total: int, batch: int) -> DataFrame:
    """SRC13: the first rows in whole batches: it ends with the batch that reaches ``total``."""
    return df.orderBy(*order).limit(-(-total // batch) * batch)


def asked_k(k: int | None, profile: str = "general") -> int:
    """SRT02, SRT03: how many chunks to retrieve when k are asked for: at least 5, 20 if none is given, at most 20 but for a summary."""
    least = max(5, k or 20)
    return least if profile == "summary" else min(least, 20)


def guided(df: DataFrame, number: str | None, kind: str | None, document: int | None) -> DataFrame:
    """FLT02: chunks (numero_expediente, document_id, tipo_documento) of a file number and a document, and of a kind in any of its spellings.

    An empty number and a blank kind do not filter; a kind is brought to its canonical form first.
    """
    if number:
        df = df.where(F.col("numero_expediente") == number)
    if document is not None:
        df = df.where(F.col("document_id") == document)
    if kind and kind.strip():
        canonical = kind_of(F.lit(kind))
        df = df.where((F.col("tipo_documento") == canonical) | ((canonical == "tecnico") & (F.col("tipo_documento") == "técnico")))
    return df


def found_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOI04: for each item (item, point_id, document_id, sha, segment) the chunk of its point id, else that of its document, hash and segment.

    chunks: chunk, point_id, document_id, sha, segment. A blank point id or an empty hash finds nothing; of several
    chunks the lowest is taken; items without one stay with null.
    """
    points = chunks.groupBy(F.col("point_id").alias("__p")).agg(F.min("chunk").alias("__by_point"))
    points = points.withColumn("__of", _deal("__p"))  # dealt once more, so Spark can split a task of a point that very many items name
    places = chunks.groupBy(_deal("document_id", "sha", "segment").alias("__of"), F.col("document_id").alias("__d"), F.col("sha").alias("__s"), F.col("segment").alias("__n"))
    places = places.agg(F.min("chunk").alias("__by_place"))
    out = _looked_up(items.select("item", "point_id", "document_id", "sha", "segment"), points, {"__p": F.nullif(F.trim("point_id"), F.lit(""))})
    out = _looked_up(out.drop("point_id"), places, {"__d": F.col("document_id"), "__s": F.nullif("sha", F.lit("")), "__n": F.col("segment")})
    return out.select("item", F.coalesce("__by_point", "__by_place").alias("chunk"))


def _deal(*columns: Column | str) -> Column:
    """A small number out of a hash of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 14)).cast("int")


def _looked_up(rows: DataFrame, table: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Rows with the other columns of the table's row whose keys are the wanted ones, null where there is none; no two rows of the table share all keys.

    Both sides meet by a hash of the keys as well, ``__of`` of the table. Where a key is missing it is one of the row, so
    that such rows do not all go to one task.
    """
    typed = [c.try_cast(table.schema[k].dataType) for k, c in wanted.items()]
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in typed))
    asked = rows.withColumn("__at", F.when(whole, _deal(*typed)).otherwise(_deal(*rows.columns)))
    same = reduce(lambda a, b: a & b, (c == F.col(k) for k, c in wanted.items()), F.col("__at") == F.col("__of"))
    return asked.join(table, same, "left").drop("__at", "__of", *wanted)


def item(hit: dict[str, Column]) -> list[Column]:
    """PRJ01: segment, text and score of a retrieved item with their defaults: -1, empty, 0 for what is not finite."""
    return [F.coalesce(hit["segment"], F.lit(-1)).alias("segment"), F.coalesce(hit["text"], F.lit("")).alias("text"), finite(hit["score"]).alias("score")]
