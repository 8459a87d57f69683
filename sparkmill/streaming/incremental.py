"""Incremental indexing: a stream of catalogue files, each batch merged by key and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkmill.operators import catalog


#: Parts of the state; a batch rewrites only those that it touches.
BUCKETS = 64


def indexed(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "name", order: str = "seq", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep ``target`` at the last state of each key of the Parquet files that arrive in ``source``.

    The state lies in buckets by the hash of the key. A batch reads the buckets of its own keys and writes them anew
    under its number, so a batch that runs twice leaves the same state; the newest version of each bucket is the state,
    the one before it is kept for a batch that runs again, older ones are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = {str(r["bucket"]) for r in batch.select(bucket.alias("bucket")).distinct().collect()}  # at most `buckets`
        paths = [v[-1][1] for b, v in _versions(session, target, number).items() if b in touched]
        before = session.read.schema(batch.schema).parquet(*paths) if paths else batch.limit(0)
        catalog.upserted(before, batch, key, order).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number:012d}")
        batch.unpersist()
        for b, versions in _versions(session, target, number + 1).items():
            for _, path in versions[:-2] if b in touched else ():
                _fs(session, path).delete(_path(session, path), True)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[str, list[tuple[str, str]]]:
    """For each bucket the folders that hold it, oldest first, of finished batches (below a number)."""
    fs, found = _fs(spark, target), {}
    if fs.exists(_path(spark, target)):
        for batch in sorted(str(f.getPath().getName()) for f in fs.listStatus(_path(spark, target))):
            if batch.startswith("batch=") and (before is None or int(batch[6:]) < before) and fs.exists(_path(spark, f"{target}/{batch}/_SUCCESS")):
                for part in fs.listStatus(_path(spark, f"{target}/{batch}")):
                    name = str(part.getPath().getName())
                    if name.startswith("bucket="):
                        found.setdefault(name[7:], []).append((batch, f"{target}/{batch}/{name}"))
    return found


def state(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The state after the last batch, or after the last one before a number; None before the first."""
    paths = [versions[-1][1] for versions in _versions(spark, target, before).values()]
    return spark.read.parquet(*paths) if paths else None


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by hour and type, for batches and for streams with a watermark."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
