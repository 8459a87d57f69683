"""Calls of injected models: batches that are halved when they fail, summaries by map and reduce, generation up to a target."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkmill.functions.text import strip
from sparkmill.operators.evaluation import good_chunk, good_question

#: A model: results for a batch of texts, in order. What loads one is called once a worker process.
Model = Callable[[list[str]], list]
Load = Callable[[], Model]
# Fixed value: what is asked of partial summaries of a section.
FUSE = "Fusiona en 3–5 líneas los siguientes subresúmenes de la sección '"

_loaded: dict[str, Model] = {}


def _model(name: str, load: Load) -> Model:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _answers(texts: list[str], model: Model, spare: Callable[[], Model] | None) -> Iterator[tuple[object, str | None]]:
    """(result, error) of each text: a batch that fails is halved until the texts that fail stand alone; these go to the spare model."""
    try:
        out = list(model(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results for {len(texts)} texts")
        yield from ((x, None) for x in out)
    except Exception as error:  # whatever a model raises becomes the row's error
        if len(texts) > 1:
            half = len(texts) // 2
            yield from _answers(texts[:half], model, spare)
            yield from _answers(texts[half:], model, spare)
        elif spare is not None:
            yield from _answers(texts, spare(), None)
        else:
            yield None, f"{type(error).__name__}: {error}"[:500]


def called(rows: DataFrame, column: str, load: Load, kind: str = "string", batch: int = 32, fallback: Load | None = None) -> DataFrame:
    """UDF01: rows with ``result`` and ``error`` of a model on a text column, ``batch`` texts at once.

    ``load`` runs once a worker process, ``fallback`` when a single text first fails, as where memory does not suffice.
    What still fails has a null result and an error; the other texts of its batch have theirs. A null text is not sent
    and has neither.
    """
    key = hashlib.sha256(cloudpickle.dumps((load, fallback))).hexdigest()  # tells models apart

    @F.pandas_udf(f"result {kind}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(key, load)
        spare = None if fallback is None else lambda: _model(f"{key}/fallback", fallback)
        for texts in batches:
            sent = texts.dropna()
            found: list[tuple[object, str | None]] = []
            for at in range(0, len(sent), batch):
                found += _answers(sent.iloc[at : at + batch].tolist(), model, spare)
            out = pd.DataFrame(found, index=sent.index, columns=["result", "error"], dtype=object).reindex(texts.index)
            yield out.astype(object).where(out.notna(), None)

    return rows.withColumn("__called", run(F.col(column))).withColumns({"result": F.col("__called.result"), "error": F.col("__called.error")}).drop("__called")


def stored(rows: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder, so that no later step calls a model again; a temporary one is set where all tasks run on this machine."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {context.master} share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sparkmill-"))
    return rows.checkpoint()


def numbered_sections(lines: DataFrame, title: Callable[[Column], Column]) -> DataFrame:
    """2.12k: (doc_id, section, title, text) of lines (doc_id, at, line): what follows each title; lines before the first are dropped, and sections without text."""
    rows = lines.withColumn("__title", title(F.col("line")))
    rows = rows.withColumn("section", F.sum(F.col("__title").cast("int")).over(Window.partitionBy("doc_id").orderBy("at"))).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("__title"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    head = F.trim(F.regexp_replace(F.max(F.when(F.col("__title"), F.col("line"))), r"[ \t]+", " "))
    return rows.groupBy("doc_id", "section").agg(head.alias("title"), strip(body).alias("text")).where("text != ''")


def pieces(rows: DataFrame, packs: Callable[[str], Iterator[str]], encode: Callable[[str], list], decode: Callable[[list], str], most: int, overlap: int) -> DataFrame:
    """2.12k: rows with (piece, part): the packs of a text, or the text where there is none; those of more than ``most`` tokens in windows that overlap.

    The columns of rows stay. A text's pieces leave the task one after another. Blank pieces are left out.
    """
    if not 0 <= overlap < most:
        raise ValueError("an overlap must be smaller than a window")
    names = rows.columns

    def windows(text: str) -> Iterator[str]:
        for pack in packs(text) or [text]:
            ids = encode(pack)
            if len(ids) <= most:
                yield pack
                continue
            start = 0
            while True:
                yield decode(ids[start : start + most])
                if start + most >= len(ids):
                    break
                start += most - overlap

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, text in enumerate(batch["text"]):
                parts = enumerate(p for p in windows(text or "") if p.strip())
                while some := list(islice(parts, 1000)):
                    own = batch.iloc[[at] * len(some)].reset_index(drop=True)
                    yield own.assign(piece=[k for k, _ in some], part=[p for _, p in some])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select(*names).mapInPandas(cut, f"{fields}, piece int, part string")


def summarized(parts: DataFrame, load: Load, fan: int = 64, batch: int = 32, fallback: Load | None = None) -> DataFrame:
    """2.12k: (doc_id, section, title, summary, pieces, calls, error) from pieces (doc_id, section, title, piece, part).

    Every piece is summed up; a section of one piece has its summary. Else the summaries, in order and without empty
    ones, are fused by the same model, ``fan`` at a time, until one is left; so no section is one task's array however
    many pieces it has, and up to ``fan`` are fused in one call. A section of which any call failed has no summary but
    the first error; one whose summary is blank is left out. Every call is made once: levels are checkpointed.
    """
    key = ["doc_id", "section"]
    level = called(parts.select(*key, "title", "piece", F.col("part").alias("asked")), "asked", load, "string", batch, fallback)
    level = stored(level.select(*key, "title", "piece", F.col("result").alias("summary"), "error", F.lit(1).cast("long").alias("pieces"), F.lit(1).cast("long").alias("calls")))
    most = level.agg(F.max("piece")).head()[0] or 0
    while most > 0:
        group = F.floor(F.col("piece") / fan).cast("int")
        said = F.array_sort(F.collect_list(F.when(F.coalesce("summary", F.lit("")) != "", F.struct("piece", "summary"))))
        bullets = F.array_join(F.transform(said, lambda x: F.concat(F.lit("- "), x["summary"])), "\n")
        first = F.min(F.when(F.col("error").isNotNull(), F.struct("piece", "error")))["error"]
        joined = level.groupBy(*key, "title", group.alias("piece")).agg(bullets.alias("bullets"), F.max("summary").alias("only"), F.count(F.lit(1)).alias("n"), first.alias("wrong"), F.sum("pieces").alias("pieces"), F.sum("calls").alias("calls"))
        fuse = F.when((F.col("n") > 1) & F.col("wrong").isNull(), F.concat(F.lit(FUSE), "title", F.lit("':\n"), "bullets"))
        out = called(joined.withColumn("asked", fuse), "asked", load, "string", batch, fallback)
        summary = F.when(F.col("wrong").isNull(), F.when(F.col("n") > 1, F.col("result")).otherwise(F.col("only")))
        level = stored(out.select(*key, "title", "piece", summary.alias("summary"), F.coalesce("wrong", "error").alias("error"), "pieces", (F.col("calls") + F.col("asked").isNotNull().cast("long")).alias("calls")))
        most //= fan
    return level.where("error is not null or trim(coalesce(summary, '')) != ''").select(*key, "title", "summary", "pieces", "calls", "error")


def generated(chunks: DataFrame, load: Load, target: int, most: int = 200, wave: int = 16, batch: int = 8, seed: int = 0) -> tuple[DataFrame, int]:
    """EVA11: questions (question, ground_truth, evidence, chunk_id) generated from chunks (chunk_id, text), and how many chunks were sent.

    Chunks that pass the gate (:func:`good_chunk`) go in an order fixed by ``seed``, at most ``most`` of them, in waves;
    the model answers each with a JSON array of question, answer and evidence. Accepted are those that pass the gate of
    questions, the first of each text whatever its case, until ``target`` are there; later waves are never sent. The
    result depends on neither partitions nor their number. Answers that are no such array, and chunks that fail, give
    nothing. A null chunk_id is as good as any.
    """
    good = chunks.select("chunk_id", "text").where(good_chunk(F.col("text")))
    order = [F.md5(F.concat_ws("/", F.lit(seed), F.col("chunk_id").cast("string"), "text")), F.col("chunk_id")]
    chosen = good.orderBy(*order).limit(most).withColumn("seq", F.row_number().over(Window.orderBy(*order)) - 1)  # at most `most` rows
    chosen = stored(chosen.select("seq", "chunk_id", "text"))
    there, sent, accepted = chosen.count(), 0, None
    item = "array<struct<question:string,answer:string,evidence:string>>"
    while sent < there and (accepted is None or accepted.count() < target):
        answers = called(chosen.where((F.col("seq") >= sent) & (F.col("seq") < sent + wave)).repartition("seq"), "text", load, "string", batch)
        rows = answers.select("seq", "chunk_id", "text", F.posexplode(F.from_json("result", item)).alias("at", "x"))
        field = lambda c: F.trim(F.coalesce(F.col(f"x.{c}"), F.lit("")))
        rows = rows.select("seq", "at", "chunk_id", "text", field("question").alias("question"), field("answer").alias("ground_truth"), field("evidence").alias("evidence"))
        rows = rows.where(good_question(F.col("question"), F.col("ground_truth"), F.col("evidence"), F.col("text"))).drop("text")
        rows = rows if accepted is None else accepted.unionByName(rows)
        first = F.row_number().over(Window.partitionBy(F.lower("question")).orderBy("seq", "at"))
        accepted = stored(rows.withColumn("__first", first).where("__first = 1").drop("__first"))
        sent = min(there, sent + wave)
    if accepted is None:
        accepted = chosen.limit(0).selectExpr("seq", "0 as at", "chunk_id", "'' as question", "'' as ground_truth", "'' as evidence")
    return accepted.orderBy("seq", "at").limit(target).select("question", "ground_truth", "evidence", "chunk_id"), sent
