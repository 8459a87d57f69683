"""Queries of retrieval: every vector whose id is divisible by 20 against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmill.operators import retrieval as R


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("tag"))
    return asked, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("tag"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.top_k(R.search(*_tables(spark, d), 20), 20)).select("qid", "id", "score", "ranking")


def topk_threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.above(R.top_k(R.search(*_tables(spark, d), 20), 20), 0.5)).select("qid", "id", "score", "ranking")


def topk_filter_relax(spark: SparkSession, d: str) -> DataFrame:
    asked, rows = _tables(spark, d)
    asked = asked.withColumn("tag", F.when(F.col("qid") % 40 == 0, F.col("tag")).otherwise(-1))  # no row has -1: those relax
    both = R.search(asked, rows, 10).withColumn("fits", F.lit(False)).unionByName(R.search(asked, rows, 10, same_tag=True).withColumn("fits", F.lit(True)))
    return _shown(R.top_k(R.relaxed(both, F.col("fits")), 10)).select("qid", "id", "score", "ranking")


def topk_best(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.best(R.search(*_tables(spark, d), R.asked_k(1))))  # one is asked for, five are retrieved


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    hits = R.top_k(R.search(*_tables(spark, d), 5), 5)
    return R.context(hits.withColumns({"file": F.concat(F.lit("v"), F.col("id")), "segment": F.lit(0), "text": F.concat(F.lit("chunk "), F.col("id"))})).select("qid", "context")


def vector_scroll(spark: SparkSession, d: str) -> DataFrame:
    """SRC12, WIN10: the page of each row when all are scrolled by id, ten at a time, and the cursor that begins it."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    w = Window.partitionBy("label").orderBy("vec_id")
    page = F.floor((F.row_number().over(w) - 1) / 10)
    return rows.withColumn("page", page).withColumn("cursor", F.min("vec_id").over(Window.partitionBy("label", "page"))).select("vec_id", "label", "page", "cursor")


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return R.matching(docs, lang="en", source="src0", kind=None, other="").select("doc_id", "n_chars")


def retrieved_items(spark: SparkSession, d: str) -> DataFrame:
    """PRJ01: shown scores of raw values that may not be finite."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    raw = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).when(F.col("l_linenumber") == 3, F.lit(None).cast("double")).otherwise(F.col("l_discount"))
    hit = {"segment": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")), "text": F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")), "score": raw}
    return rows.select("l_orderkey", "l_linenumber", *R.item(hit))


_HITS = """with s as (
    select q.vec_id qid, e.vec_id id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) score, q.label ql, e.label el
    from embeddings q, embeddings e where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by qid order by score desc, id) ranking from s)
"""

QUERIES = {
    "topk_cosine": (topk_cosine, _HITS + "select qid, id, round(score, 6) score, ranking from r where ranking <= 20"),
    "topk_threshold_fallback": (
        topk_threshold_fallback,
        _HITS + (
            ", t as (select * from r where ranking <= 20), a as (select qid, max(score) > 0.5 as above from t group by qid) select qid, id, "
            "round(score, 6) score, ranking from t join a using (qid) where score > 0.5 or not above"
        ),
    ),
    "topk_filter_relax": (
        topk_filter_relax,
        _HITS + (
            ", f as (select * from s where qid % 40 != 0 or ql = el), g as (select *, row_number() over (partition by qid order by score desc, "
            "id) k from f) select qid, id, round(score, 6) score, k ranking from g where k <= 10"
        ),
    ),
    "topk_best": (topk_best, _HITS + "select qid, id, round(score, 6) score from r where ranking = 1"),
    "context_blocks": (
        context_blocks,
        _HITS + """select qid, string_agg(printf('[CHUNK #%d | score=%.6f | file=v%d | seg=0]', ranking, score, id) || chr(10) || '\"\"\"chunk ' || id || '\"\"\"', chr(10) order by ranking) context from r where ranking <= 5 group by qid""",
    ),
    "vector_scroll": (
        vector_scroll,
        (
            "select vec_id, label, page, min(vec_id) over (partition by label, page) \"cursor\" from (select vec_id, label, ((row_number() "
            "over (partition by label order by vec_id) - 1) // 10)::bigint page from embeddings)"
        ),
    ),
    "metadata_filter": (metadata_filter, "select doc_id, n_chars from documents where lang = 'en' and source = 'src0'"),
    "retrieved_items": (retrieved_items, (
        "select l_orderkey, l_linenumber, case l_linenumber % 2 when 0 then l_suppkey else -1 end::bigint segment, case l_linenumber % 3 "
        "when 0 then l_returnflag else '' end \"text\", case when l_linenumber <= 3 then 0.0 else l_discount end::double score from "
        "lineitem"
    )),
}
