"""Queries against their SQL on rows that only larger tables hold, and steps whose tasks must not grow with one key."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from compare import connect, plain
from pyspark.sql import functions as F

from sparkmill.functions import reflow as W, text as T
from sparkmill.operators import anchors, retrieval as R
from sparkmill.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def same(spark, folder, name):
    want = connect(str(folder)).execute(catalogue.oracle_sql()[name]).fetchdf()
    got = catalogue.queries()[name](spark, str(folder)).toPandas()
    assert len(want) and plain(got) == plain(want)


def test_progress_of_large_keys(spark, tmp_path):
    keys = "select unnest([0, 5, 1000, 214792, 262144, 786432, 1199999, 1258290])::bigint k"
    duckdb.sql(f"copy (select t.* replace (k as p_partkey) from (select * from '{SMALL}/part.parquet' limit 40) t, ({keys})) to '{tmp_path}/part.parquet'")
    same(spark, tmp_path, "progress_lines")


def test_bytes_are_rounded_from_their_exact_value(spark):
    shown = lambda n, *a: spark.range(1).select(T.bytes_shown(F.lit(n), *a)).head()[0]
    assert [shown(n) for n in (1023, 1280, 1792, 3 * 1024**3, 5 * 1024**5)] == ["1023 B", "1.2 KB", "1.8 KB", "3.0 GB", "5120.0 TB"]
    assert shown(3 * 1024**3, "MB") == "3072.0 MB"


def pages(tmp_path, rows):
    """Pages of given urls and html, both SQL."""
    duckdb.sql(f"copy (select row_number() over ()::bigint page_id, url, html from (values {', '.join(f'({u}, {h})' for u, h in rows)}) t(url, html)) to '{tmp_path}/pages.parquet'")


def test_sizes_of_pages_round_as_their_sql(spark, tmp_path):
    """Ties of KB and MB go up, those of GB to even; sizes past the range of an int."""
    lengths = (0, 1, 2, 32, 96, 160, 224, 800, 1048, 1049, 32768, 98304, 1073741, 1073742, 2147484, 33554432)
    pages(tmp_path, [("'http://a'", f"repeat('x', {n})") for n in lengths])
    same(spark, tmp_path, "name_functions")
    shown = {r["page_id"]: r["size"] for r in catalogue.queries()["name_functions"](spark, str(tmp_path)).collect()}
    assert [shown[i] for i in (1, 4, 5, 11, 16)] == ["0 B", "31.3 KB", "93.8 KB", "31.3 MB", "31.2 GB"]


def test_names_of_odd_pages(spark, tmp_path):
    """White space at the cut of a long page, which patterns of Java and RE2 tell apart, and pages without url or html."""
    ends = ("' '", "chr(10)", "' ' || chr(10)", "chr(13) || chr(10)", "chr(9) || chr(12)", "chr(11)", "' ' || chr(11)", "chr(11) || ' '", "' ' || chr(133)", "' ' || chr(8232)", "' ' || chr(160)", "chr(160) || ' '", "chr(128512) || ' '")
    cut = [("'http://a'", f"repeat('a', 252 - length({e})) || {e} || repeat('z', 9)") for e in ends]
    blank = [(u, "'<p>'") for u in ("null", "''", "' '", "'. .'", "'...'", "'a/ñ.'")]
    pages(tmp_path, [*cut, *blank, ("'http://a'", "null"), ("'http://a'", "repeat(' ', 300)")])
    same(spark, tmp_path, "name_functions")


def test_summaries_of_numbered_lines(spark, tmp_path):
    numbered = "4801146876264569 Thing eren ones lyly.\n70.32.29.134 Tioning to, thorea.\n2.5 Apartado\n2.5  Apartados y mas"
    duckdb.sql(f"copy (select * replace (replace(text, chr(10), chr(10) || '{numbered}' || chr(10)) as text) from '{SMALL}/documents.parquet' limit 40) to '{tmp_path}/documents.parquet'".replace("\n", "' || chr(10) || '"))
    same(spark, tmp_path, "section_summaries")


def test_items_without_a_key_go_to_many_tasks(spark):
    chunks = spark.createDataFrame([(7, "p", 1, "a", 0)], "chunk long, point_id string, document_id long, sha string, segment int")
    rows = spark.range(20_000).withColumn("key", F.when(F.col("id") % 10 == 0, " p ").when(F.col("id") % 10 > 5, " "))
    items = rows.select(F.col("id").alias("item"), F.col("key").alias("point_id"), F.lit(None).cast("int").alias("document_id"), F.lit("").alias("sha"), F.lit(0).alias("segment"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = R.found_chunks(items, chunks)
        assert found.where("chunk = 7").count() == 2_000 and found.count() == 20_000
        assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tasks_of_a_hot_point_are_split(spark):
    """A point that most items name, and keys of another type than the chunks'."""
    chunks = spark.range(1_000).select(F.col("id").alias("chunk"), F.concat(F.lit("p"), "id").alias("point_id"), F.col("id").alias("document_id"), F.lit("a").alias("sha"), F.lit(0).alias("segment"))
    items = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("item"), F.when(F.col("id") % 5 != 0, "nowhere").otherwise(F.concat(F.lit("p"), F.col("id") % 1000)).alias("point_id"), (F.col("id") % 1000).cast("int").alias("document_id"), F.lit("a").alias("sha"), F.lit(0).cast("long").alias("segment"))
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "adaptive.advisoryPartitionSizeInBytes": "20k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        found = R.found_chunks(items, chunks)
        assert found.where("chunk = item % 1000").count() == 200_000
        assert "skew=true" in executed(found)
    finally:
        for k in small:
            spark.conf.unset(f"spark.sql.{k}")


def executed(rows):
    """The plan as it was run."""
    plan = rows._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    return plan.executedPlan().toString()


def test_a_text_is_made_once(spark):
    text = W.processed(F.expr("concat(text, 'made')"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert text._jc.toString().count("'made'") + text._jc.toString().count("made") <= 2
    plan = anchors.resolved(docs, W.with_titles(W.with_index_links(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_pages_of_tenders_are_many_tasks(spark):
    assert catalogue.queries()["tender_documents"](spark, SMALL).rdd.getNumPartitions() >= 16


def test_scores_of_few_queries_are_held_at_once(spark, monkeypatch):
    seen, better = [], R._better
    monkeypatch.setattr(R, "_better", lambda *a: seen.append(a[-1].shape) or better(*a))
    rows = [pd.DataFrame({"id": range(600), "v": [np.array([1.0, i]) for i in range(600)], "tag": [""] * 600})]
    asked = spark.range(3_000).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("q"))
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    kept = []
    monkeypatch.setattr(type(corpus), "mapInPandas", lambda self, f, schema: kept.append(f) or spark.createDataFrame([], schema))
    R.search(asked, corpus, 1)
    out = next(kept[0](iter(rows)))
    assert len(out) == 3_000 and max(n for n, _ in seen) <= 1_024
    assert out[out.qid < 100].eval("qid == id").all()
