"""A corpus from raw documents: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage works on all that the stage before it kept, written as Parquet and read again; all but the last return the
columns of documents. They handle null and empty texts, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmill.llm import op3_ngram_join, op4_language, op7_line_dedup, op9_packing, op10_decontamination, scratch

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on docs whose own columns of these names, which it uses for itself, are out of its way."""
    aside = {c: f"__own_{c}" for c in names if c in docs.columns}
    return work(docs.withColumnsRenamed(aside)).withColumnsRenamed({v: k for k, v in aside.items()})


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter, or no more like a prototype than unrelated texts, go.

    So null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    return _beside(docs, ("lang_pred", "score"), lambda own: op4_language.recognised(own).drop("lang_pred", "score"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks and passages that stand earlier; a document of which nothing is left goes.

    Null and empty texts stay; rows equal in doc_id and text are one document and keep what is first in it; null ids
    come before all others.
    """
    left = "n_removed = 0 or trim(translate(text, '\\n', ' ')) != ''"
    return _recounted(_beside(docs, ("n_removed",), lambda own: op7_line_dedup.without_repeats(own).where(left).drop("n_removed")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: that of the least doc_id, of rows with one doc_id one of them.

    Rows are told apart, not ids, by a hash of all their columns; so a repeated or null doc_id is as good as any; null
    ones come last. Of rows equal in all columns one stays. Texts without words stay.
    """
    rows = docs.withColumn("__row", F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))
    groups = scratch.keep(op3_ngram_join.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")), "groups-of-rows")
    known = groups.join(rows.select(F.col("__row").alias("doc_id"), F.col("doc_id").alias("own")).distinct(), "doc_id")
    place = F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")
    leads = known.where("n_shingles > 0").groupBy("component_id").agg(F.min(place)["doc_id"].alias("__row"), F.lit(True).alias("words"))
    leads = leads.select("__row", "words").unionByName(known.where("n_shingles = 0").select(F.col("doc_id").alias("__row"), F.lit(False).alias("words")).distinct())
    copies = groups.groupBy(F.col("doc_id").alias("__row")).agg((F.count(F.lit(1)) > 1).alias("copies"))
    leads = scratch.keep(leads.join(copies, "__row").select("__row", (F.col("words") & F.col("copies")).alias("once")), "leads")
    if leads.count() <= op3_ngram_join.BROADCAST_ROWS:  # else both sides are shuffled
        leads = F.broadcast(leads)
    kept = rows.join(leads, "__row")
    if leads.where("once").isEmpty():
        return kept.drop("__row", "once")
    return kept.where("not once").unionByName(kept.where("once").dropDuplicates(["__row"])).drop("__row", "once")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; a document of which nothing is left goes.

    Null texts and texts that had no words before stay; repeated rows are cut alike.
    """
    clean = op10_decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    return _recounted(clean.where("text is null or text rlike '[0-9a-zA-Z\\\\x{80}-\\\\x{10FFFF}]' or n_chars = length(text)"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048; a null or empty text is a piece of the end id, repeated rows are packed each."""
    return op9_packing.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.steps(spark):
        for name, stage in STAGES[:-1]:
            with scratch.steps(spark):  # what a stage's result reads goes when the result is written
                docs = scratch.keep(stage(spark, docs, sf_dir), name, stay=True)
        name, stage = STAGES[-1]
        return scratch.keep(stage(spark, docs, sf_dir), name, stay=True)
