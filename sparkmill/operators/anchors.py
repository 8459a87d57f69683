"""Links from the entries of an index to the headings of the same document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkmill.functions.markdown import lines
from sparkmill.functions.reflow import slug


def resolved(docs: DataFrame, text: Column) -> DataFrame:
    """2.12d: (doc_id, at, title, slug, headings, target, state) of every index entry ``- [title](#slug)`` of a Markdown text.

    ``headings`` is how many headings of the document have that anchor, ``target`` the line of the first, ``state``
    linked, dangling (none) or ambiguous (several). Lines count from 0. Only lines that are entries or headings are
    shuffled, and the text is made once. Rows that share a doc_id, null too, are documents of their own; a text without entries has no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", lines(text).alias("lines"))
    found = rows.select("__row", "doc_id", F.posexplode("lines").alias("at", "line"))
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)
    entry = F.when(F.col("line").rlike(r"^- \[.*\]\(#[^()]*\)$"), F.col("line"))
    found = found.select("__row", "doc_id", "at", F.nullif(heading, F.lit("")).alias("heading"), F.regexp_extract(entry, r"^- \[(.*)\]\(#", 1).alias("title"), F.regexp_extract(entry, r"\(#([^()]*)\)$", 1).alias("anchor"))
    found = found.where("heading is not null or title is not null").withColumn("slug", F.coalesce("anchor", slug(F.col("heading"))))
    same, at = Window.partitionBy("__row", "slug"), F.when(F.col("heading").isNotNull(), F.col("at"))
    out = found.withColumns({"headings": F.count(at).over(same), "target": F.min(at).over(same)}).where("title is not null")
    state = F.when(F.col("headings") == 0, "dangling").when(F.col("headings") == 1, "linked").otherwise("ambiguous")
    return out.select("doc_id", "at", "title", "slug", "headings", "target", state.alias("state"))
