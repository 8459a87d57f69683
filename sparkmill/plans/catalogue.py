"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import calls, documents, indexing, inputs, lifecycle, records, reflow, retrieval, stored, usage

_ALL = retrieval.QUERIES | usage.QUERIES | documents.QUERIES | indexing.QUERIES | records.QUERIES | lifecycle.QUERIES | inputs.QUERIES | reflow.QUERIES | calls.QUERIES | stored.QUERIES


def queries() -> dict[str, Callable]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
