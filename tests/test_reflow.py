"""Re-flow, titles and anchors: golden values and odd texts."""

import time

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import reflow as W
from sparkmill.operators import anchors


def on(spark, function, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    return [r["out"] for r in rows.select("i", function(F.col("t")).alias("out")).orderBy("i").collect()]


def test_reflowed(spark):
    text = "• Uno con-\ntinuación y\nmás ▪texto  \n\n\n\nDos-\n\nTres\nCu-\na-\ntro\n"
    assert on(spark, W.reflowed, text, None, "", " \n \n") == [" Uno continuación y más texto\n\nDos-\n\nTres Cua- tro ", "", "", "    "]


def test_index_lines(spark):
    lines = ["1. Objeto ...... 12", "Anexo.....3", "x  .....  7", "x  ..... 7", ".......9", ".....9", "sin puntos 4", "a.....b..... 2", "Ámbito y régimen: ¿qué? ........ 5"]
    assert on(spark, W.index_title, *lines) == ["1. Objeto", "Anexo", None, "x ", ".", None, None, "a.....b", "Ámbito y régimen: ¿qué?"]
    assert on(spark, W.with_index_links, "Ámbito y régimen: ¿qué? ........ 5\nx") == ["- [Ámbito y régimen: ¿qué?](#ámbito-y-régimen-qué)\nx"]


def test_titles_look_ahead(spark):
    text = "\n".join(["portada", "PLIEGO DE CONDICIONES", "I.", "OBJETO DEL CONTRATO", "II.", "no es título", "1.1", "Alcance", "1.2.", "1.3.", "# ya", "G.2.2.", "MEDIOS TÉCNICOS", "3. Plazos", "CAPITULO FINAL", "2."])
    want = "portada\n\n# PLIEGO DE CONDICIONES\n\n\n## I. OBJETO DEL CONTRATO\n\nII.\nno es título\n\n## 1.1. Alcance\n\n\n## 1.2. 1.3.\n\n# ya\n\n## G.2.2. MEDIOS TÉCNICOS\n\n### 3. Plazos\n\n## CAPITULO FINAL\n\n2."
    assert on(spark, W.with_titles, text, None, "") == [want, "", ""]
    levels = on(spark, W.title_levels, text)[0]
    assert [(x["at"], x["level"], x["title"]) for x in levels] == [(1, 1, "PLIEGO DE CONDICIONES"), (2, 2, "I. OBJETO DEL CONTRATO"), (6, 2, "1.1. Alcance"), (8, 2, "1.2. 1.3."), (11, 2, "G.2.2. MEDIOS TÉCNICOS"), (13, 3, "3. Plazos"), (14, 2, "CAPITULO FINAL")]


def test_the_main_title_stands_among_the_first_lines(spark):
    late = "\n".join(["x"] * 15 + ["TITULO TARDIO"])
    last = "\n".join(["x"] * 14 + ["TITULO TARDIO", "OTRO TITULO"])
    taken = "1.1\nTITULO TOMADO\nOTRO TITULO"
    got = on(spark, W.title_levels, late, last, taken)
    assert [[x["level"] for x in g] for g in got] == [[2], [1, 2], [2, 1]]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1. OBJETO", (1, "1. OBJETO")),
        ("1 OBJETO", (1, "1. OBJETO")),
        ("1. Objeto", None),
        ("1.1. Objeto", (2, "1.1. Objeto")),
        ("1.2.3.4.5.6.7.8 x", (6, "1.2.3.4.5.6.7.8. x")),
        ("G.2.2.  Medios ", (3, "G.2.2. Medios")),
        ("1.- Lista", None),
        ("1..2 x", None),
        ("g.1 x", None),
        ("", None),
        ("1.", None),
    ],
)
def test_numbered_heading(spark, line, want):
    got = on(spark, W.numbered_heading, line)[0]
    assert (got and tuple(got)) == want


def test_markdown_of_plain_text(spark):
    text = "TITULO\nNOTA:\nABC\n  \n• uno\n  - dos\no tres\notro\n1.1 Cuatro\n cinco"
    assert on(spark, W.markdown_of, text, None) == ["# TITULO\nNOTA:\nABC\n\n- uno\n- dos\n- tres\notro\n## 1.1. Cuatro\n- cinco", ""]


def test_numbered_headings_and_dots(spark):
    lines = ["1. TITULO", "1. titulo", "1.1. x", "1.2.3. y", "1.2.3.4. z", "G.2.2.", "G.2.2.Texto", "A.1.2x", "A.1.. x", " 1.1. x", "- 1.1. x", "123. TITULO"]
    want = ["# 1. TITULO", "1. titulo", "## 1.1. x", "### 1.2.3. y", "1.2.3.4. z", "### G.2.2.", "### G.2.2. Texto", "### A.1. 2x", "### A.1. . x", " 1.1. x", "- 1.1. x", "123. TITULO"]
    assert on(spark, W.with_numbered_headings, "\n".join(lines)) == ["\n".join(want)]
    assert on(spark, W.without_first_dots, "a....3 b....4\n.....\n \nx.. 4\ny ..... 12 fin\nz...") == ["a 3 b....4\n \nx.. 4\ny 12 fin\nz..."]


def test_anchors(spark):
    text = "- [Uno](#uno)\n- [Dos](#dos)\n- [Tres](#tres)\n# Uno\n## Dos\n### Dos\ntexto"
    docs = spark.createDataFrame([(7, text), (7, "- [Uno](#uno)"), (None, "# Uno\n- [Uno](#uno)"), (8, None), (9, "")], "doc_id long, t string").repartition(3)
    got = sorted((str(r["doc_id"]), r["at"], r["slug"], r["headings"], r["target"], r["state"]) for r in anchors.resolved(docs, F.col("t")).collect())
    assert got == [("7", 0, "uno", 0, None, "dangling"), ("7", 0, "uno", 1, 3, "linked"), ("7", 1, "dos", 2, 4, "ambiguous"), ("7", 2, "tres", 0, None, "dangling"), ("None", 1, "uno", 1, 0, "linked")]
    assert anchors.resolved(docs.limit(0), F.col("t")).count() == 0


@pytest.mark.parametrize("text", ["a" * 5_000_000, "." * 5_000_000, " " * 2_500_000 + "x", "1." * 2_500_000, "\n" * 1_000_000, "I.\n" * 300_000 + "FINAL DEL TEXTO", "palabra cor-\ntada " * 300_000])
def test_five_megabytes(spark, text):
    began = time.time()
    rows = spark.createDataFrame([(text,)], "t string")
    rows.select(F.length(W.processed(F.col("t"))), F.length(W.markdown_of(F.col("t"))), F.length(W.with_numbered_headings(F.col("t"))), F.length(W.without_first_dots(F.col("t"))), F.size(W.title_levels(F.col("t")))).collect()
    assert time.time() - began < 180
