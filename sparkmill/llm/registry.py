"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import (
    op1_url_filter as op1,
    op2_license as op2,
    op3_ngram_join as op3,
    op4_language as op4,
    op5_quality as op5,
    op6_nn_descent as op6,
    op7_line_dedup as op7,
    op8_token_file as op8,
    op9_packing as op9,
    op10_decontamination as op10,
    op11_conversation_repair as op11,
    op12_whitening as op12,
    op13_binary_packing as op13,
)

_OPERATORS = {
    "op1_url_filter": op1,
    "op2_license": op2,
    "op3_ngram_join": op3,
    "op4_language": op4,
    "op5_quality": op5,
    "op6_nn_descent": op6,
    "op7_line_dedup": op7,
    "op8_token_file": op8,
    "op9_packing": op9,
    "op10_decontamination": op10,
    "op11_conversation_repair": op11,
    "op12_whitening": op12,
    "op13_binary_packing": op13,
}


def queries() -> dict[str, Callable]:
    return {name: op.query for name, op in _OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: op.SQL for name, op in _OPERATORS.items() if getattr(op, "SQL", None)}
