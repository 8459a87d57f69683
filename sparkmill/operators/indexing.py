"""From stored documents to an index of chunks: extraction of records, upserts of chunk metadata, job states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkmill.functions.text import first_url, strip
from sparkmill.operators.calls import called


def tender_files(tenders: DataFrame) -> DataFrame:
    """GEN01: (number, name, url, nth) of the documents of each tender whose name says that they are specifications and that have a first address.

    tenders: datos, a struct of Expediente and Documentos (an array of structs of Documento and urls). Tenders without a
    number are left out; documents of a number are counted from 1 (AGG32).
    """
    rows = tenders.select(strip(F.col("datos.Expediente")).alias("number"), F.posexplode("datos.Documentos").alias("at", "d"))
    rows = rows.select("number", "at", strip(F.col("d.Documento")).alias("name"), first_url(F.col("d.urls")).alias("url"))
    rows = rows.where((F.coalesce("number", F.lit("")) != "") & F.contains(F.lower("name"), F.lit("pliego")) & F.col("url").isNotNull())
    nth = F.row_number().over(Window.partitionBy("number").orderBy("at", "name", "url"))
    return rows.withColumn("nth", nth).drop("at")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """SNK11: one row for each (document_id, sha256, segment), the last by seq; rows without a hash or with a segment below 0 are left out."""
    ok = (F.coalesce(F.trim("sha256"), F.lit("")) != "") & (F.col("segment") >= 0)
    last = F.row_number().over(Window.partitionBy("document_id", "sha256", "segment").orderBy(F.desc("seq")))
    return chunks.where(ok).withColumn("__r", last).where("__r = 1").drop("__r")


def synced(documents: DataFrame, files: DataFrame) -> DataFrame:
    """SNK12: documents (path, hash, markdown, status) after the files (path, hash) were seen: a changed hash clears the text, new paths come in as ``cargado``."""
    d, f = documents.alias("d"), files.alias("f")
    both = d.join(f, F.col("d.path") == F.col("f.path"), "full_outer")
    changed = F.col("f.path").isNotNull() & F.col("d.path").isNotNull() & ~F.col("d.hash").eqNullSafe(F.col("f.hash"))
    return both.select(
        F.coalesce("d.path", "f.path").alias("path"),
        F.coalesce("f.hash", "d.hash").alias("hash"),
        F.when(~changed, F.col("d.markdown")).alias("markdown"),
        F.when(F.col("d.path").isNull() | changed, "cargado").otherwise(F.col("d.status")).alias("status"),
    )


def job_states(log: DataFrame) -> DataFrame:
    """FSM02: the state of each job after its log (job, at, event): the last event that changes it, when it began and when it ended."""
    ended = F.col("event").isin("done", "failed", "cancelled")
    return log.groupBy("job").agg(
        F.max_by("event", F.struct("at", "event")).alias("status"),
        F.min(F.when(F.col("event") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("finished_at"),
    )


def response_seconds(elapsed: Column, started: Column, finished: Column, created: Column) -> Column:
    """DT04: the measured seconds, else those between begin (or creation) and end, not below 0."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(elapsed, F.greatest(F.lit(0.0), (micros(finished) - micros(F.coalesce(started, created))) / 1e6))


def best_fragment(consultas: DataFrame, bridge: DataFrame) -> DataFrame:
    """JOI08, SRT11: the chunk of the best rank of each question: from its own fragments, else from the bridge (id, chunk, ranking)."""
    own = F.array_sort(F.transform("fragments", lambda x: F.struct(F.coalesce(x["ranking"], F.lit(0)).alias("r"), x["chunk"].alias("c"))))
    other = bridge.groupBy("id").agg(F.min_by("chunk", F.struct("ranking", "chunk")).alias("__chunk"))
    return consultas.join(other, "id", "left").select("id", F.coalesce(F.get(own, F.lit(0))["c"], "__chunk").alias("chunk"))


def merged_metadata(own: Column, other: Column) -> Column:
    """PRJ04, MAP01: a map with what the other one adds; keys that are there win and blanks are left out."""
    filled = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    a, b = filled(own), filled(other)
    return F.map_concat(a, F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(a), k)))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "text", batch: int = 32, fallback: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """UDF01, EVA07: rows with ``vector`` of a text from an injected model, ``batch`` texts at once; a blank text is one space.

    A batch that fails is halved, a single text that fails goes to the ``fallback`` model; without a vector in the end,
    ``error`` says why. See :func:`.calls.called` for models that must be loaded.
    """
    text = F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", " ").otherwise(F.col(column))
    out = called(rows.withColumn("__text", text), "__text", lambda: embed, "array<double>", batch, fallback and (lambda: fallback))
    return out.withColumnRenamed("result", "vector").drop("__text")


#: What is asked for in an answer, by profile of the question; ``general`` stands for all others.
PROFILE_TASKS = {
    "general": "Answer the question directly, then add the details and conditions that matter. Say what the fragments do not tell.",
    "summary": "Sum up the whole document, section by section, and end with its main points. Name the sections that are missing.",
    "amounts": "List every amount, percentage and formula, with what it is for, its period or lot, and whether tax is included.",
    "deadlines": "List every date and period in order, with when it begins, when it ends and what it depends on.",
    "solvency": "List the economic, technical and professional requirements, their least values and the documents that prove them.",
    "criteria": "List the award criteria with their weights, apart those that a formula decides and those that are judged.",
    "guarantees": "List the provisional and final guarantees, their amounts, forms and terms.",
    "budget": "Give the base budget and the estimated value, how they come about, and what is included.",
    "duration": "Give the duration of the contract, its start, its possible extensions and their conditions.",
    "penalties": "List the penalties, breaches and grounds for termination, each with its consequence.",
    "submission": "Tell how, where and until when an offer is submitted, in which envelopes or files, and with which documents.",
}
TEMPLATE = "{task}\nUse nothing but the fragments ({range}).\n\nQuestion:\n{question}\n\nFragments:\n{context}\n"


def prompt(template: str | Column, question: Column, context: Column) -> Column:
    """STR17: a template with its ``{question}`` and ``{context}`` filled in."""
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(template, F.lit("{context}"), context), F.lit("{question}"), question)


def profile_prompt(profile: Column, question: Column, blocks: Column, tasks: dict[str, str] = PROFILE_TASKS, template: str = TEMPLATE) -> Column:
    """STR17: the prompt of a question of some profile over context blocks; an unknown or null profile is ``general``.

    ``{range}`` becomes the numbers of the blocks, ``CHUNK #1`` to the last, or a dash without any.
    """
    names = F.create_map(*(F.lit(x) for p in tasks.items() for x in p))
    n = F.size(F.coalesce(blocks, F.array().cast("array<string>")))
    span = F.when(n > 1, F.concat(F.lit("CHUNK #1-"), n.cast("string"))).when(n == 1, "CHUNK #1").otherwise("-")
    text = F.replace(F.replace(F.lit(template), F.lit("{task}"), F.coalesce(F.try_element_at(names, profile), F.lit(tasks["general"]))), F.lit("{range}"), span)
    return prompt(text, F.coalesce(question, F.lit("")), F.coalesce(F.array_join(blocks, "\n"), F.lit("")))
