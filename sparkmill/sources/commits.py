"""Several tables that change in one step: staged folders, made visible by one manifest that is written last."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_MANIFESTS = "_manifests"
_local: list[str] = []
_passing: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which all machines share; a temporary folder where all tasks run on this machine."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {spark.sparkContext.master} share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="sparkmill-"))
    return _local[0]


def passing(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one that goes when this process ends."""
    _passing.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")
    return _passing[-1]


def _clear_at_exit() -> None:
    if _passing and (spark := SparkSession.getActiveSession()) is not None and spark.sparkContext._jsc is not None:
        while _passing:
            folder = _Folder(spark, _passing.pop())
            folder.files.delete(folder.path(""), True)


atexit.register(_clear_at_exit)


class _Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        if not self.files.exists(self.path(_MANIFESTS)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(_MANIFESTS))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self.files.open(self.path(f"{_MANIFESTS}/{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, manifest: dict) -> None:
        """Write a manifest beside the others and move it to its name; a name that is there is never replaced."""
        staged, final = self.path(f"{_MANIFESTS}/.{uuid.uuid4().hex}"), self.path(f"{_MANIFESTS}/{version:012d}.json")
        stream = self.files.create(staged, False)
        try:
            stream.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            stream.close()
        if self.files.exists(final) or not self.files.rename(staged, final):
            self.files.delete(staged, False)
            raise RuntimeError(f"another commit has made version {version}")


def committed(spark: SparkSession, root: str) -> dict:
    """The manifest that counts: ``tables`` (name to folders) and the ``batches`` it holds; empty before the first commit."""
    folder = _Folder(spark, root)
    versions = folder.versions()
    return folder.read(versions[-1]) if versions else {"tables": {}, "batches": []}


def commit(root: str, batch: str, tables: dict[str, DataFrame]) -> bool:
    """SNK14: append rows to several tables at once; whether this batch was new.

    Every table is written to a folder of its own that nothing reads yet; the manifest that names them is written last.
    A failure before that leaves the old state, and the batch may be sent again; a batch that is committed is not
    written twice. Of two writers at a time one gets an error and changes nothing. Folders of failed batches stay
    until they are removed; no reader sees them.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, before = _Folder(spark, root), committed(spark, root)
    if batch in before["batches"]:
        return False
    versions, now = folder.versions(), {k: list(v) for k, v in before["tables"].items()}
    for name, rows in tables.items():
        place = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder.root}/{place}")
        now.setdefault(name, []).append(place)
    folder.files.mkdirs(folder.path(_MANIFESTS))
    folder.publish(versions[-1] + 1 if versions else 0, {"tables": now, "batches": [*before["batches"], batch]})
    return True


def table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table that are committed; none before its first commit."""
    places = committed(spark, root)["tables"].get(name, [])
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root.rstrip('/')}/{p}" for p in places))


def persist_answers(root: str, batch: str, answers: DataFrame, k: int = 10) -> bool:
    """SNK08, SNK14: answers (id, user_id, fragments and more) with their first k fragments, and their bridge rows, in one step.

    Rows without a user are skipped. See :func:`commit`.
    """
    from sparkmill.operators.records import stored_fragments

    kept, bridge = stored_fragments(answers.where(F.col("user_id").isNotNull()), k)
    return commit(root, batch, {"answers": kept, "bridge": bridge})
