"""The catalogue of documents: upserts, differences by content hash, purges and states.

Tables are plain data sets here; an upsert returns the table's next state, in the shape of a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """SNK01, SET03: all rows with the last one of each key; rows with a null or blank key are all kept."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order)))
    return both.where(blank).unionByName(both.where(~blank).withColumn("__r", rank).where("__r = 1").drop("__r")).drop("__new")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """JOI13, AGG28: (name, state) of two catalogues (name, hash): new, changed, unchanged or gone."""
    state = F.when(F.col("o.name").isNull(), "new").when(F.col("n.name").isNull(), "gone").when(F.col("o.hash").eqNullSafe(F.col("n.hash")), "unchanged").otherwise("changed")
    joined = old.select("name", "hash").alias("o").join(new.select("name", "hash").alias("n"), F.col("o.name") == F.col("n.name"), "full_outer")
    return joined.select(F.coalesce("o.name", "n.name").alias("name"), state.alias("state"))


def tally(rows: DataFrame, outcome: str = "state") -> DataFrame:
    """AGG27, AGG28: rows of each outcome."""
    return rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def purged(table: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """JOI11, JOI12: rows whose key is still there."""
    return table.join(present.select(key).distinct(), key, "left_semi")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """JOI05, DEL01 to DEL04: rows whose key is not among those to delete."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def exists(table: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """FLT17: each probed key and whether the table has it."""
    have = table.select(key).distinct().withColumn("found", F.lit(True))
    return probe.select(key).distinct().join(have, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def resolved(candidates: DataFrame, known: DataFrame, plain, compact) -> DataFrame:
    """JOI14, JOI04: for each candidate the known value that equals it when normalized, else when compacted, else itself."""
    first = lambda f: known.groupBy(f(F.col("value")).alias("__k")).agg(F.min("value").alias("__v"))
    one, two = first(plain), first(compact)
    out = candidates.withColumns({"__p": plain(F.col("candidate")), "__c": compact(F.col("candidate"))})
    out = out.join(one.select(F.col("__k").alias("__p"), F.col("__v").alias("__v1")), "__p", "left").join(two.select(F.col("__k").alias("__c"), F.col("__v").alias("__v2")), "__c", "left")
    return out.withColumn("resolved", F.coalesce("__v1", "__v2", "candidate")).drop("__p", "__c", "__v1", "__v2")


def status(current: Column, markdown: Column) -> Column:
    """FSM01: a document with text is ``con markdown`` unless it is indexed."""
    has = F.coalesce(markdown, F.lit("")) != ""
    return F.when(has & (current != "indexado"), "con markdown").otherwise(current)


def stale(job_status: Column, started: Column, created: Column, boot: Column) -> Column:
    """FLT16: still active though begun before the process."""
    return job_status.isin("queued", "running") & (F.coalesce(started, created) < boot)


def kinds_per_file(docs: DataFrame) -> DataFrame:
    """AGG18: the kinds of each file number, sorted; rows (number, kind)."""
    kind = F.nullif(F.lower(F.trim("kind")), F.lit(""))
    return docs.groupBy("number").agg(F.array_sort(F.collect_set(kind)).alias("kinds"))


def choices(docs: DataFrame) -> DataFrame:
    """AGG19: for each file number its kinds and its shortest name, of equal lengths the first without regard to case."""
    name = F.min_by("name", F.struct(F.length("name"), F.lower("name"), F.col("name")))
    return docs.groupBy("number").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), name.alias("name"))


def options(table: DataFrame, column: str) -> DataFrame:
    """AGG20: the distinct values that are not blank, in order."""
    value = F.nullif(F.trim(column), F.lit(""))
    return table.select(value.alias("option")).where("option is not null").distinct().orderBy("option")


def filtered(docs: DataFrame, name: str | None = None, kind: str | None = None, markdown: bool | None = None) -> DataFrame:
    """FLT05, FLT06, FLT15: documents by part of their name, kind (``unknown``: none) and whether they have text."""
    if name:
        docs = docs.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kind:
        docs = docs.where(F.col("kind").isNull() if kind == "unknown" else F.col("kind") == kind)
    if markdown is not None:
        has = F.coalesce("markdown", F.lit("")) != ""
        docs = docs.where(has if markdown else ~has)
    return docs
