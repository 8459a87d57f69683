"""Evaluation of answers: cosine metrics, judge scores and their merge, summaries and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .retrieval import clamped, similarity

#: Names of the metrics. Fixed values.
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "context_relevancy", "answer_correctness")
#: Weights of judge and cosine scores. Fixed values.
JUDGE_WEIGHT, COSINE_WEIGHT = 0.7, 0.3


def valid(c: Column) -> Column:
    """FLT18: neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def combined(judge: Column, cosine: Column, judge_weight: float = JUDGE_WEIGHT, cosine_weight: float = COSINE_WEIGHT) -> Column:
    """MTH03: the weighted mean of both; the one that is valid alone; null without any. Weights of 0 leave the judge's."""
    total = judge_weight + cosine_weight
    both = clamped(judge) if total <= 0 else clamped((judge * judge_weight + cosine * cosine_weight) / total)
    return F.when(valid(judge) & valid(cosine), both).when(valid(judge), clamped(judge)).when(valid(cosine), clamped(cosine))


def source(judge: Column, cosine: Column) -> Column:
    """EVA08: where a merged score comes from; cosine also where neither is valid."""
    return F.when(valid(judge) & valid(cosine), "weighted").when(valid(judge), "ragas").otherwise("coseno")


def mean(c: Column) -> Column:
    """AGG21: mean of the valid values."""
    return F.avg(F.when(valid(c), c))


def summarized(rows: DataFrame, names: list[str]) -> DataFrame:
    """AGG22: (metric, n, mean) of each named column; mean null without valid values."""
    long = rows.select(*names).unpivot([], names, "metric", "value")
    return long.groupBy("metric").agg(F.count(F.when(valid(F.col("value")), 1)).alias("n"), clamped(mean(F.col("value"))).alias("mean"))


def source_counts(rows: DataFrame) -> DataFrame:
    """AGG23: for each metric how many scores have each source; unknown and absent ones are missing. Rows (metric, source)."""
    known = F.when(F.col("source").isin("weighted", "ragas", "coseno"), F.col("source")).otherwise("missing")
    return rows.groupBy("metric").agg(*(F.count(F.when(known == s, 1)).alias(s) for s in ("weighted", "ragas", "coseno", "missing")))


def diagnostics(rows: DataFrame) -> DataFrame:
    """AGG24: (column, filled, issue): how many values are there, and what is wrong where some or all are missing."""
    counts = rows.agg(F.count(F.lit(1)).alias("__all"), *(F.count(c).alias(c) for c in rows.columns)).unpivot(["__all"], rows.columns, "column", "filled")
    issue = F.when(F.col("__all") == 0, "no rows").when(F.col("filled") == 0, "all null").when(F.col("filled") < F.col("__all"), "some null")
    return counts.select("column", "filled", issue.alias("issue"))


def _mean(values: Column) -> Column:
    """Of an array; 0 for an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def cosine_metrics(rows: DataFrame) -> DataFrame:
    """EVA01 to EVA06, MTH05: per row (qid, question, answer, truth, evidence, contexts, joined) its six cosine metrics.

    All but qid are vectors, contexts an array of them and joined that of the joined contexts; truth and evidence may be
    null. Every cosine is brought within 0 and 1 before it is averaged. Without contexts their metrics are 0; without
    a truth the answer has no correctness and the evidence stands for it.
    """
    contexts = F.coalesce("contexts", F.array().cast("array<array<double>>"))
    near = lambda a: lambda c: similarity(F.col(a), c)
    other = lambda a, c: F.when(F.col(a).isNotNull(), similarity(F.col(a), c)).otherwise(0.0)
    return rows.select(
        "qid",
        F.coalesce(F.array_max(F.transform(contexts, near("answer"))), F.lit(0.0)).alias("faithfulness"),
        similarity(F.col("question"), F.col("answer")).alias("answer_relevancy"),
        F.when(F.col("truth").isNotNull(), similarity(F.col("answer"), F.col("truth"))).alias("answer_correctness"),
        _mean(F.transform(contexts, lambda c: F.greatest(other("truth", c), other("evidence", c), similarity(F.col("question"), c)))).alias("context_precision"),
        F.when(F.size(contexts) > 0, similarity(F.col("joined"), F.coalesce("truth", "evidence"))).otherwise(0.0).alias("context_recall"),
        _mean(F.transform(contexts, near("question"))).alias("context_relevancy"),
    )


def chosen(metrics: Column) -> Column:
    """EVA09: the valid names among those asked for, all six if none is."""
    every = F.array(*(F.lit(m) for m in METRICS))
    found = F.array_intersect(F.coalesce(metrics, F.array().cast("array<string>")), every)
    return F.when(F.size(found) > 0, found).otherwise(every)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def good_chunk(text: Column) -> Column:
    """FLT11: 500 to 4000 characters and at most five page marks of either kind."""
    return F.coalesce(F.length(text).between(500, 4000) & (occurrences(text, "Pagina") <= 5) & (occurrences(text, "Pág") <= 5), F.lit(False))


def good_question(question: Column, answer: Column, evidence: Column, chunk: Column) -> Column:
    """FLT12: nothing empty, at least six words, and the evidence stands in the chunk."""
    filled = reduce(lambda a, b: a & b, (F.coalesce(F.trim(c), F.lit("")) != "" for c in (question, answer, evidence)))
    return filled & (F.size(F.split(F.trim(question), r"\s+")) >= 6) & F.coalesce(F.contains(chunk, evidence), F.lit(False))


def asked_well(question: Column) -> Column:
    """FLT13: 1 to 2000 characters."""
    return F.coalesce(F.length(F.trim(question)).between(1, 2000), F.lit(False))


def first_asked(rows: DataFrame) -> DataFrame:
    """SET02: the first row (question, seq) of each question, whatever its case."""
    key = F.lower(F.trim("question"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("__r = 1").drop("__r")


def evaluation_rows(rows: DataFrame, k: int = 3) -> DataFrame:
    """PRJ05: the first k contexts that are not blank, and the reference: the truth or else the evidence."""
    contexts = F.slice(F.filter("contexts", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""), 1, k)
    return rows.withColumns({"retrieved_contexts": contexts, "reference": F.coalesce(F.nullif(F.trim("ground_truth"), F.lit("")), "evidence"), "user_input": F.col("question"), "response": F.col("answer")})
