"""Tables written between steps, in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to Python at once where these are texts; a batch is held several times over on either side.
BATCH_ROWS = 2_000

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL: list[str] = []
_open = threading.local()
#: Tables that results still read when the outermost :func:`steps` ended.
_left: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where that is unset and all tasks run on this machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sparkmill-"))
    return _LOCAL[0]


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def _stack() -> list[list[str]]:
    if not hasattr(_open, "stack"):
        _open.stack = []
    return _open.stack


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are removed at the end; those kept with ``stay`` are left to the steps around these, or to :func:`clear`.

    At the end of the outermost steps the session's size of Arrow batches is what it was before.
    """
    stack = _stack()
    before = spark.conf.get(_ROWS)
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            drop(spark, path)
        if not stack and spark.conf.get(_ROWS) != before:
            spark.conf.set(_ROWS, before)


def keep(df: DataFrame, what: str, codec: str = "snappy", stay: bool = False) -> DataFrame:
    """Write ``df`` and read it back: later jobs read the table, so a lost executor costs no recomputation of what came before.

    The readers need no lineage, and a second use of the result does not run the plan again. ``stay``: the result of
    the :func:`steps` reads it.
    """
    spark = df.sparkSession
    path = fresh(spark, what)
    leave(path, stay)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Have Arrow hand at most ``BATCH_ROWS`` rows to Python at once in this session; less stays less.

    It holds until the :func:`steps` around this end; without any it stays, for results that are computed later.
    """
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def leave(path: str, stay: bool = False) -> None:
    """Have a path of :func:`fresh` removed as one of :func:`keep` is."""
    stack = _stack()[: -1 if stay else None]
    (stack[-1] if stack else _left).append(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table of :func:`fresh` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Remove the tables that results still read: call it when these have been written or collected."""
    while _left:
        drop(spark, _left.pop())


def _clear_at_exit() -> None:
    if _left and (spark := SparkSession.getActiveSession()) is not None and spark.sparkContext._jsc is not None:
        clear(spark)


atexit.register(_clear_at_exit)
