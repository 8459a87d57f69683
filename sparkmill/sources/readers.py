"""Readers of the inputs: folders of files, JSON arrays, question lists and tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """SRC01, STR27: (name, path, size, modified, sha256) of the files of a folder, their bytes read in tasks."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    """SRC16, SRC17: whether the bytes begin as a PDF does."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder has this path, which may be a pattern."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC09: rows of the JSON arrays in the files of a path; elements that do not fit the schema are left out.

    A file that is damaged or no array gives no rows, nor does a path that is not there. A file is one value of a task.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return json_elements(spark.read.text(path, wholetext=True), F.col("value"), schema)


def json_elements(rows: DataFrame, text: Column, schema: T.StructType) -> DataFrame:
    """SRC09: a row for each element of a text's JSON array that fits the schema; null and damaged texts have none."""
    elements = rows.select(F.explode(F.from_json(text, "array<string>")).alias("element"))
    known = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    one = F.from_json("element", known, {"columnNameOfCorruptRecord": "__corrupt"})
    return elements.select(one.alias("x")).where("x is not null and x.__corrupt is null").select(*(F.col(f"x.`{f.name}`").alias(f.name) for f in schema.fields))


def questions(rows: DataFrame, column: str = "value") -> DataFrame:
    """SRC10: (question, ground_truth, evidence) from JSON strings or objects, one in each row."""
    text = F.trim(column)
    one = F.from_json(text, "question string, ground_truth string, evidence string")
    plain = F.when(~F.startswith(text, F.lit("{")), F.regexp_replace(text, '^"|"$', ""))
    return rows.select(F.coalesce(plain, one["question"]).alias("question"), one["ground_truth"].alias("ground_truth"), one["evidence"].alias("evidence"))


def streamed_answer(rows: DataFrame, key: str = "id", order: str = "seq", column: str = "line") -> DataFrame:
    """SRC15: an answer from its NDJSON lines up to the one that says it is done."""
    x = F.from_json(column, "message struct<content:string>, response string, done boolean")
    piece = F.coalesce(x["message"]["content"], x["response"], F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t"), F.coalesce(x["done"], F.lit(False)).alias("done"))))
    last = F.array_min(F.transform(F.filter("parts", lambda p: p["done"]), lambda p: p["o"]))
    kept = F.filter("parts", lambda p: F.coalesce(p["o"] <= last, F.lit(True)))
    return rows.groupBy(key).agg(parts.alias("parts")).select(key, F.array_join(F.transform(kept, lambda p: p["t"]), "").alias("answer"))


def sink_tsv(df: DataFrame, path: str) -> None:
    """SNK05: a tab-separated data set with its header."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def sink_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK03, SNK04, SNK10: JSON lines; ``mode`` ``ignore`` leaves what is there."""
    df.write.mode(mode).json(path)


def sink_artefacts(folder: str, rows: DataFrame, summary: DataFrame, diagnostics: DataFrame, config: dict | None = None) -> None:
    """SNK06: the three results of an evaluation and its configuration, side by side."""
    for name, table in (("rows", rows), ("summary", summary), ("diagnostics", diagnostics)):
        sink_json(table, f"{folder}/{name}")
    if config is not None:
        rows.sparkSession.createDataFrame([(json.dumps(config, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/config")


def artefact_folder(root: str, now: datetime) -> str:
    """SNK09: the folder of an evaluation at a time."""
    return f"{root.rstrip('/')}/evaluations/{now:%Y%m%d_%H%M%S}"


def created(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SNK02: the table at a path, made empty where there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def sink_markdown(docs: DataFrame, path: str, key: str = "doc_id", text: str = "markdown") -> None:
    """SNK07: each document's text in a folder of its own; null and empty ones have none."""
    kept = docs.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(key).cast("string").alias("document"), F.col(text).alias("value"))
    kept.write.partitionBy("document").text(path)
