"""A data source of document files around a given parser: a partition a file, rows of pages, errors as rows.

``spark.dataSource.register(DocumentSource)`` and ``spark.read.format("documents").option("parser", "module:function")``.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, size long, sha256 string, title string, pages int, page int, text string, error string"
#: What needs the parser, and what needs the file's bytes.
_PARSED, _READ = {"title", "pages", "page", "text", "error"}, {"sha256"}


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class DocumentReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.names
        self.options = dict(options)

    def partitions(self) -> list[File]:
        """SRC01: a file each, sorted by name; folders are searched as deep as they go."""
        root, pattern = self.options["path"].removeprefix("file://"), self.options.get("pathglobfilter", "*.pdf")
        found = [os.path.join(place, f) for place, _, files in os.walk(root) for f in files if fnmatch.fnmatch(f, pattern)]
        return [File(p) for p in sorted(found, key=lambda p: (os.path.basename(p), p))]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        path, wanted = partition.path, set(self.names)
        row = {"path": path, "name": os.path.basename(path), "size": os.path.getsize(path)}
        try:
            data = b""
            if wanted & (_PARSED | _READ):
                with open(path, "rb") as f:
                    data = f.read()
                row["sha256"] = hashlib.sha256(data).hexdigest()
            if not wanted & _PARSED:
                yield tuple(row.get(c) for c in self.names)
                return
            module, _, name = self.options["parser"].partition(":")
            title, texts = getattr(import_module(module), name)(data)
            if not texts:
                raise ValueError("no pages")
            row |= {"title": title, "pages": len(texts)}
        except Exception as error:  # an unreadable file is a row that says why
            yield tuple((row | {"error": f"{type(error).__name__}: {error}"[:500]}).get(c) for c in self.names)
            return
        for page, text in enumerate(texts if wanted & {"page", "text"} else [None], 1):
            yield tuple((row | {"page": page, "text": text}).get(c) for c in self.names)


class DocumentSource(DataSource):
    """SRC02, SRC03: the pages of the files of a folder that all machines share.

    Options: ``path``, ``pathGlobFilter`` (``*.pdf``) and ``parser``, a ``module:function`` from a file's bytes to its
    title and the texts of its pages, at most one file in a task at a time. Columns that a schema leaves out are not
    made: without those of the parser it is not called, without the hash no file is opened. A file that cannot be read,
    or has no pages, is one row with its error.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(schema, self.options)


def _give(spark: SparkSession, module: str) -> None:
    """A module that is one file of this process to all executors; what is part of a package must be installed there."""
    try:
        found = find_spec(module) if module.isidentifier() else None
    except ValueError:  # one without a file
        found = None
    if found and found.has_location and found.origin.endswith(".py") and not found.submodule_search_locations:
        spark.sparkContext.addPyFile(found.origin)


def pages(spark: SparkSession, folder: str, parser: str, pattern: str = "*.pdf", columns: str = SCHEMA) -> DataFrame:
    """SRC02: pages of the files of a folder; ``columns`` is the part of :data:`SCHEMA` that is wanted. The executors get the parser's module."""
    _give(spark, parser.partition(":")[0])
    spark.dataSource.register(DocumentSource)
    return spark.read.format("documents").schema(columns).option("parser", parser).option("pathGlobFilter", pattern).load(folder)


def whole(rows: DataFrame) -> DataFrame:
    """SRC02, SRC03: (path, name, title, pages, text, error) of pages: their texts in order, a line each; readable files first, by pages and name (SRT09).

    A missing title is the name without its ending. Pages without a text count but add nothing.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("page", "text")))), lambda x: x["text"]), "\n")
    out = rows.groupBy("path", "name", "title", "pages", "error").agg(text.alias("text"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace("name", r"\.[^.]*$", ""))
    return out.select("path", "name", title.alias("title"), "pages", "text", "error").orderBy(F.col("error").isNotNull(), "pages", "name")

