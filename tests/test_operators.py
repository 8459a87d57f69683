"""Golden values of single operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import markdown as M, text as T
from sparkmill.operators import catalog as C, chunking, evaluation as E, lifecycle as L, retrieval as R, usage as U
from sparkmill.sources import html as H, readers
from sparkmill.streaming import incremental


def value(spark, expression, **columns):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()) if columns else "id").select(expression.alias("x")).head()
    return row["x"]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (T.normalized, "  Técnico   Ágil\nMunicipal  ", "tecnico agil municipal"),
        (T.normalized, None, ""),
        (T.kind, "TÉCNICO", "tecnico"),
        (T.kind, "Tecnica", "tecnico"),
        (T.kind, " ADMINISTRATIVO ", "administrativo"),
        (T.kind_asked, "Resume el pliego administrativo del contrato", "administrativo"),
        (T.kind_asked, "¿Qué dicen las prescripciones tecnicas?", "tecnico"),
        (T.kind_asked, "pliego tecnico y pliego administrativo", None),
        (T.file_number, "Háblame del expediente EXP-1 sobre pliegos", "EXP-1"),
        (T.file_number, 'expediente "EXP/2026-001" por favor', "EXP/2026-001"),
        (T.file_number, "nada", None),
        (T.snake, "VectorBaseDocument", "vector_base_document"),
        (T.safe_name, " a/b:ñ. ", "a_b_ñ"),
        (T.safe_name, None, "expediente"),
        (T.first_url, " http://a | http://b", "http://a"),
        (T.bytes_shown, 1536, "1.5 KB"),
        (M.is_upper, "1234", False),
        (M.is_upper, "Titulo normal", False),
        (M.without_dot_leaders, "1. OBJETO............. 3\n.....\nTexto normal", "1. OBJETO 3\nTexto normal"),
        (M.with_headings, "1. OBJETO DEL CONTRATO", "# 1. OBJETO DEL CONTRATO"),
        (M.with_headings, "1.1. Alcance", "## 1.1. Alcance"),
        (M.with_headings, "1.1 Alcance", "1.1 Alcance"),
        (M.with_headings, "A.1. Texto\n", "### A.1. Texto"),
        (M.with_headings, "1.1.1. Detalle", "### 1.1.1. Detalle"),
        (M.with_headings, "G.2.2. Codigo", "### G.2.2. Codigo"),
        (M.with_headings, "- 1. Lista", "- 1. Lista"),
        (E.good_chunk, "a" * 499, False),
        (E.good_chunk, "a" * 4001, False),
        (E.good_chunk, "a" * 600, True),
        (E.good_chunk, "Pagina " * 6 + "a" * 600, False),
        (E.asked_well, "", False),
        (E.asked_well, "x" * 2001, False),
        (E.asked_well, "¿Qué?", True),
    ],
)
def test_scalar(spark, function, given, want):
    assert value(spark, function(F.col("c")), c=given if given is not None else F.lit(None).cast("string")) == want


def test_profiles(spark):
    ask = lambda t: tuple(value(spark, T.profile(F.col("c")), c=t))
    assert ask("Resumen general y detallado del documento") == ("summary", 80)
    assert ask("¿Qué importes hay?") == ("amounts", 18)
    assert ask("hola") == ("general", 20)
    k = lambda p, n: value(spark, T.retrieval_k(F.col("p"), F.col("n")), p=p, n=n)
    assert (k("general", 1), k("criteria", 999), k("summary", 80)) == (5, 20, 80)


def test_marker_and_file_name(spark):
    assert tuple(value(spark, T.kind_override(F.col("c")), c="  [doc_type=Administrativo]  Resume el documento  ")) == ("Resume el documento", "administrativo")
    name = lambda c: tuple(value(spark, T.named_file(F.col("c")), c=c))
    assert name("EXP-123__Pliego_de_clausulas_administrativas_1.pdf") == ("EXP-123", "administrativo")
    assert name("EXP-123__Pliego_de_prescripciones_tecnicas_2.pdf") == ("EXP-123", "tecnico")


@pytest.mark.parametrize(("judge", "cosine", "want"), [(0.8, 0.2, 0.62), (0.9, None, 0.9), (None, 0.1, 0.1), (None, None, None), (math.nan, 0.5, 0.5)])
def test_combined(spark, judge, cosine, want):
    row = spark.createDataFrame([(judge, cosine)], "j double, c double").select(E.combined(F.col("j"), F.col("c")).alias("x")).head()
    assert row["x"] == (pytest.approx(want) if want is not None else None)


def test_mean_skips_nan_and_null(spark):
    rows = spark.createDataFrame([(0.5,), (math.nan,), (0.75,), (None,)], "v double")
    assert rows.agg(E.mean(F.col("v")).alias("m")).head()["m"] == 0.625


def test_threshold_is_strict_and_falls_back(spark):
    hits = spark.createDataFrame([(1, 1, 0.51), (1, 2, 0.5), (2, 1, 0.1), (2, 2, 0.2)], "qid long, id long, score double")
    assert {(r["qid"], r["id"]) for r in R.above(hits, 0.5).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_zero_vector(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert rows.select(R.similarity(F.col("a"), F.col("b")).alias("s")).head()["s"] == 0.0
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "id long, v array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, q array<double>")
    assert [r["id"] for r in R.search(asked, corpus, 5).collect()] == [2]


def test_empty_log(spark):
    log = spark.createDataFrame([], "user_id long, ts timestamp_ntz, seconds double, model string, device string, tokens long")
    assert tuple(U.summary(log).head())[:3] == (0, 0.0, 0)
    assert U.by_month(log).count() == U.by_day(log).count() == U.calendar(log).count() == 0
    assert tuple(U.distribution(U.per_user(log, spark.createDataFrame([], "id long, name string"))).head()) == (0.0, 0.0, 0.0)


def test_page_is_clamped(spark):
    rows = spark.range(2)
    assert [r["id"] for r in R.page(rows, [F.col("id")], -4, 1).collect()] == [0]
    assert [r["id"] for r in R.page(rows, [F.col("id")], 99, 1).collect()] == [1]


def test_packed_lines():
    tokens = lambda x: None if x == "BAD" else len(x.split())
    lines = ["uno dos", "BAD", "tres cuatro", "cinco seis", "siete"]
    assert chunking.packed(lines, 4, 2, tokens) == ["uno dos tres cuatro", "tres cuatro cinco seis", "cinco seis siete"]
    assert chunking.packed([], 4, 2, tokens) == []
    assert chunking.packed(["a b c d e f"], 4, 2, tokens) == ["a b c d e f"]


def test_chunks_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x\n\n y ")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk"]) for r in chunking.chunked(docs).collect()] == [(3, "x y")]


def test_sections(spark):
    text = "intro\n\nANEXO I\n a\nb \nOBJETO DEL CONTRATO\n1 Objeto ........ 4\nCAPITULOS\nVACIO AQUI\n \n1.2 Plazos\nc\nanexo 2 y fin\nd\n" + "LARGO " * 21 + "\n1.2 x"
    docs = spark.createDataFrame([(1, text), (1, "1 Uno dos\nx"), (None, "y"), (2, None), (3, "ANEXO I")], "doc_id long, text string").repartition(2)
    got = sorted(((r["doc_id"], r["section"], r["title"], r["text"]) for r in chunking.sections(docs).collect()), key=str)
    want = [(1, 0, "Preámbulo", "intro"), (1, 1, "ANEXO I", "a\nb"), (1, 2, "OBJETO DEL CONTRATO", "1 Objeto ........ 4\nCAPITULOS"), (1, 4, "1.2 Plazos", "c"), (1, 5, "anexo 2 y fin", "d\n" + "LARGO " * 21 + "\n1.2 x"), (1, 1, "1 Uno dos", "x"), (None, 0, "Preámbulo", "y")]
    assert got == sorted(want, key=str)


def test_search_of_several_lengths_and_kinds_of_ids(spark):
    corpus = spark.createDataFrame([("bb", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("c", [0.0, 1.0, 0.0]), ("a longer name", [0.0, 1.0])], "id string, v array<double>").repartition(2)
    asked = spark.createDataFrame([("x", [0.0, 1.0, 0.0]), ("y", [1.0, 0.1]), (None, [1.0, 0.0]), ("z", [1.0]), ("w", None)], "qid string, q array<double>")
    got = sorted((r["qid"], r["id"]) for r in R.search(asked, corpus, 3).collect())
    assert got == [("x", "c"), ("y", "a"), ("y", "a longer name"), ("y", "bb")]
    assert sorted((r["qid"], r["id"]) for r in R.search(asked.orderBy(F.desc("qid")), corpus, 2).collect()) == [("x", "c"), ("y", "a"), ("y", "bb")]
    big = spark.createDataFrame([(2**53 + 1, [1.0, 0.0]), (None, [1.0, 0.0])], "id long, v array<double>")
    assert [r["id"] for r in R.search(spark.createDataFrame([(2**53 + 3, [1.0, 0.0])], "qid long, q array<double>"), big, 5).collect()] == [2**53 + 1]


def test_throttled_progress(spark):
    rows = [("j", 0.0, 1, "s", "a", False), ("j", 1.0, 2, "s", "b", False), ("j", 5.0, 3, "s", "b", False), ("j", 5.5, 4, "s", "c", True), ("j", 9.0, 5, "", "d", True), ("j", 20.0, 6, "s", None, True), (None, 0.0, 7, "s", "a", False), (None, 9.0, 8, "s", "a", False)]
    table = spark.createDataFrame(rows, "job string, at double, seq long, status string, text string, done boolean").repartition(3)
    assert sorted(r["seq"] for r in L.throttled(table, 4.0).collect()) == [1, 3, 4, 7]


def test_models_as_they_are_compared(spark):
    rows = [(" m ", 1, 5, None, "CUDA GPU 0", "done"), ("m", 1, 6, None, "cpu x", "done"), (None, 2, None, 2.0, None, "done"), ("", 3, 1, 4.0, "GPU/CPU", "done"), ("m", 9, 9, 9.0, "CPU", "failed")]
    got = {r["model"]: tuple(r)[1:] for r in U.models(spark.createDataFrame(rows, "model string, user_id int, tokens long, seconds double, device string, status string"), "none").collect()}
    assert got == {"m": (2, 1, 11, 0.0, 1, 1, 0), "none": (2, 2, 1, 3.0, 1, 0, 1)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "name string, seq int")
    new = spark.createDataFrame([("a", 0), ("b", 5), ("b", 6)], "name string, seq int")
    got = sorted((r["name"] or "", r["seq"]) for r in C.upserted(old, new, "name", "seq").collect())
    assert got == [("", 2), ("", 3), ("a", 0), ("b", 6)]


def test_html(spark):
    row = spark.range(1).select(F.lit('<title> A &amp; <b>B</b> </title><table><tr><th>Objeto</th><td> x <i>y</i></td></tr></table><a class="k" href="/p?q#r">').alias("h"))
    got = row.select(H.title(F.col("h")).alias("t"), H.label_values(F.col("h")).alias("m"), H.hrefs(F.col("h")).alias("l")).head()
    assert (got["t"], got["m"], got["l"]) == ("A & B", {"Objeto": "x y"}, ["/p?q#r"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    got = {r["name"]: r["is_pdf"] for r in readers.files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}
    rows = spark.createDataFrame([('{"question": "q1", "evidence": "e"}',), ("plain",)], "value string")
    assert sorted((r["question"], r["evidence"] or "") for r in readers.questions(rows).collect()) == [("plain", ""), ("q1", "e")]
    lines = spark.createDataFrame([(1, 1, '{"message":{"content":"Ho"}}'), (1, 2, '{"response":"la","done":true}'), (1, 3, '{"response":"!"}')], "id int, seq int, line string")
    assert readers.streamed_answer(lines).head()["answer"] == "Hola"


def test_incremental_index(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "name string, hash string, seq int"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema).write.mode("append").parquet(source)
    incremental.indexed(spark, source, schema, target, mark).awaitTermination()
    spark.createDataFrame([("a", "2", 2), ("c", "1", 2)], schema).write.mode("append").parquet(source)
    incremental.indexed(spark, source, schema, target, mark).awaitTermination()
    assert sorted((r["name"], r["hash"]) for r in incremental.state(spark, target).collect()) == [("a", "2"), ("b", "1"), ("c", "1")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("expediente número: EXP/1 de obras", "EXP/1 de obras"),
        ("expediente nº 12-A y pliego", "12-A"),
        ("Expediente # A1 B2 C3 D4 E5 F6 G7", "A1 B2 C3 D4 E5 F6"),
        ("expediente EXP-1, que trata", "EXP-1"),
        ("expediente EXP.1.", "EXP.1"),
        ("expediente del pliego", None),
        ("expediente “A B C”", "A B C"),
        ("el expediente", None),
    ],
)
def test_file_numbers(spark, text, want):
    assert value(spark, T.file_number(F.col("c")), c=text) == want


def test_sinks_and_json_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb"), (2, None)], "id int, text string")
    readers.sink_tsv(rows, str(tmp_path / "tsv"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert sorted((r["id"], r["text"] or "") for r in back.collect()) == [("1", "a\tb"), ("2", "")]
    readers.sink_json(rows, str(tmp_path / "json"))
    readers.sink_json(rows.limit(0), str(tmp_path / "json"), "ignore")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    folder = readers.artefact_folder(f"{tmp_path}/", datetime(2026, 1, 2, 3, 4, 5))
    assert folder == f"{tmp_path}/evaluations/20260102_030405"
    readers.sink_artefacts(folder, rows, rows.limit(1), E.diagnostics(rows))
    assert [spark.read.json(f"{folder}/{n}").count() for n in ("rows", "summary", "diagnostics")] == [2, 1, 2]
    for _ in range(2):
        assert readers.created(spark, str(tmp_path / "made"), "id int").count() == 0
    readers.sink_markdown(rows.withColumn("id", F.lit("x/y")), str(tmp_path / "md"), "id", "text")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["a\tb"]
    (tmp_path / "a.json").write_text('[{"q": "one", "n": 1}, {"q": "two", "n": "x"}]')
    got = readers.json_array(spark, str(tmp_path / "a.json"), spark.createDataFrame([], "q string, n int").schema)
    assert [(r["q"], r["n"]) for r in got.collect()] == [("one", 1)]
    (tmp_path / "b.json").write_text('[{"q": "one", "n"')
    (tmp_path / "c.json").write_text('{"q": "one"}')
    (tmp_path / "d.json").write_text('[{"q": "two"}, 7, null, [], {"n": 2, "more": {"x": []}}]')
    for name, want in (("b", []), ("c", []), ("none", []), ("d", [("two", None), (None, 2)]), ("[bd]", [("two", None), (None, 2)])):
        assert [(r["q"], r["n"]) for r in readers.json_array(spark, str(tmp_path / f"{name}.json"), got.schema).collect()] == want


def test_sentences(spark):
    one, two = "Una frase de prueba con palabras. " * 20, "Otra más larga que sigue aquí. " * 30
    docs = spark.createDataFrame([(1, one + two), (2, "corta."), (3, None), (4, "x" * 2000 + ". " + "y" * 900 + ".")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["segment"], r["chunk"]) for r in L.packed_sentences(docs).collect())
    first = [c for i, _, c in got if i == 1]
    assert " ".join(first) in " ".join((one + two).split()) and all(800 <= len(c) <= 1200 for c in first)
    assert [len(c) for i, _, c in got if i == 4] == [2001, 901] and not any(i in (2, 3) for i, *_ in got)


def test_prompt_embedding_and_choice(spark):
    from sparkmill.operators import indexing as X

    row = spark.range(1).select(X.prompt("Q: {question} C: {context}", F.lit("why {context}?"), F.lit("text")).alias("p"), E.chosen(F.array(F.lit("faithfulness"), F.lit("nonsense"))).alias("c"), E.chosen(F.lit(None).cast("array<string>")).alias("all")).head()
    assert row["c"] == ["faithfulness"] and len(row["all"]) == 6 and row["p"].startswith("Q: why")
    texts = spark.createDataFrame([(1, "ab"), (2, " "), (3, None)], "id int, text string")
    seen = X.embedded(texts, lambda batch: [[float(len(t))] for t in batch], batch=2)
    assert sorted((r["id"], r["vector"]) for r in seen.collect()) == [(1, [2.0]), (2, [1.0]), (3, [1.0])]


def test_points_fail_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "s", "a\nb"), (2, "s", "a\nzzz"), (3, "s", None)], "doc_id long, sha string, text string")
    got = L.points(docs, lambda c: F.when(~F.contains(c, F.lit("zzz")), F.array(F.length(c))), 1)
    assert sorted((r["document_id"], r["segment"]) for r in got.collect()) == [(1, 0), (1, 1)]


def test_incremental_buckets(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for i in range(4):
        spark.createDataFrame([("a", str(i), i), (f"k{i}", "1", i)], "name string, hash string, seq int").write.mode("append").parquet(source)
        incremental.indexed(spark, source, "name string, hash string, seq int", target, mark, buckets=4).awaitTermination()
    assert sorted((r["name"], r["hash"]) for r in incremental.state(spark, target).collect()) == [("a", "3"), *((f"k{i}", "1") for i in range(4))]
    assert all(len(v) <= 2 for v in incremental._versions(spark, target).values())
