"""Model calls: loads, failures, summaries of sections, generation up to a target."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkmill.operators import calls, chunking, indexing as X, lifecycle as L


def logged(path, model):
    """A loader that notes each load and each call."""

    def load():
        def note(what):
            with open(path, "a") as f:
                f.write(what + "\n")

        note(f"load {os.getpid()}")

        def run(texts):
            note(f"call {len(texts)}")
            return model(texts)

        return run

    return load


def notes(path, what):
    return [line.split()[1] for line in open(path) if line.startswith(what)]


@pytest.mark.parametrize("bad", [{0}, {49}, {99}, {0, 49, 99}, set()])
def test_only_failing_rows_have_errors(spark, tmp_path, bad):
    def model(texts):
        if any(int(t) in bad for t in texts):
            raise RuntimeError("cannot")
        return [int(t) * 2 for t in texts]

    rows = spark.range(100).select("id", F.col("id").cast("string").alias("t"), F.lit("own").alias("result")).coalesce(1)
    got = calls.called(rows, "t", logged(f"{tmp_path}/log", model), "long", 16).collect()
    assert {r["id"]: (r["result"], r["error"]) for r in got} == {i: (None, "RuntimeError: cannot") if i in bad else (2 * i, None) for i in range(100)}


def test_one_load_a_worker_and_smaller_batches_after_memory_ran_out(spark, tmp_path):
    def model(texts):
        if len(texts) > 4:
            raise MemoryError
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(i, None if i % 10 == 3 else f"t{i}") for i in range(64)], "id int, t string").repartition(8)
    got = calls.called(rows, "t", logged(f"{tmp_path}/log", model), batch=32).collect()
    assert all((r["result"], r["error"]) == (None if r["t"] is None else r["t"].upper(), None) for r in got)
    loads = notes(f"{tmp_path}/log", "load")
    assert len(loads) == len(set(loads))


def test_fallback_and_wrong_counts(spark):
    broken = lambda: lambda texts: []
    spare = lambda: lambda texts: [f"<{t}>" for t in texts]
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    assert sorted(str(r["result"]) for r in calls.called(rows, "t", broken, fallback=spare).collect()) == ["<a>", "<b>", "None"]
    assert {r["error"] for r in calls.called(rows, "t", broken).collect()} == {None, "ValueError: 0 results for 1 texts"}
    assert calls.called(rows.limit(0), "t", broken).count() == 0
    vectors = X.embedded(spark.createDataFrame([(1, None), (2, "ab")], "id int, text string"), lambda b: [[float(len(t))] for t in b])
    assert {r["id"]: (r["vector"], r["error"]) for r in vectors.collect()} == {1: ([1.0], None), 2: ([2.0], None)}


def brute(parts, fan):
    """(summary, calls) of a section by plain recursion; a summary is the texts' first letters."""
    short = lambda t: "".join(w[0] for w in t.split())
    level, n = [short(p) for p in parts], len(parts)
    while len(level) > 1:
        groups = [level[i : i + fan] for i in range(0, len(level), fan)]
        n += sum(len(g) > 1 for g in groups)
        level = [short(f"{calls.FUSE}T':\n" + "\n".join(f"- {p}" for p in g)) if len(g) > 1 else g[0] for g in groups]
    return level[0], n


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_summaries_of_sections(spark, tmp_path, fan):
    sizes = {1: 1, 2: 2, 3: 3, 4: 7, 5: 200}
    rows = [(None if s == 4 else 9, s, "T", k, f"word{k} of{s} x{k % 5}") for s, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, section int, title string, piece int, part string").repartition(5)
    load = logged(f"{tmp_path}/log", lambda texts: ["".join(w[0] for w in t.split()) for t in texts])
    got = {r["section"]: (r["summary"], r["calls"], r["pieces"], r["error"]) for r in calls.summarized(table, load, fan).collect()}
    want = {s: brute([f"word{k} of{s} x{k % 5}" for k in range(n)], fan) for s, n in sizes.items()}
    assert got == {s: (*want[s], sizes[s], None) for s in sizes}
    assert sum(map(int, notes(f"{tmp_path}/log", "call"))) == sum(n for _, n in want.values())  # each call once


def test_a_failing_pack_drops_its_section_and_says_so(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return ["" if "empty" in t else "s" for t in texts]

    rows = [(1, 1, "A", 0, "x"), (1, 1, "A", 1, "bad"), (1, 2, "B", 0, "y"), (1, 3, "C", 0, "empty"), (2, 1, "D", 0, "x"), (2, 1, "D", 1, "empty")]
    table = spark.createDataFrame(rows, "doc_id int, section int, title string, piece int, part string")
    got = sorted((r["title"], r["summary"], r["error"]) for r in calls.summarized(table, lambda: model).collect())
    assert got == [("A", None, "RuntimeError: no"), ("B", "s", None), ("D", "s", None)]
    assert calls.summarized(table.limit(0), lambda: model).count() == 0


def test_sections_and_pieces(spark):
    lines = [(1, 0, "before"), (1, 1, "1 Objeto"), (1, 2, "one"), (1, 3, "two"), (1, 4, "2.1 Vacío"), (1, 5, "3 Fin"), (1, 6, " "), (2, 0, "nothing")]
    sections = calls.numbered_sections(spark.createDataFrame(lines, "doc_id int, at int, line string"), L.section_title)
    assert [tuple(r) for r in sections.collect()] == [(1, 1, "1 Objeto", "one\ntwo")]
    rows = spark.createDataFrame([(2**53 + 1, "a b c d e f g"), (None, "a"), (3, None), (4, " ")], "id long, text string")
    got = sorted(((r["id"], r["piece"], r["part"]) for r in calls.pieces(rows, lambda t: [], str.split, " ".join, 4, 1).collect()), key=str)
    assert got == sorted([(2**53 + 1, 0, "a b c d"), (2**53 + 1, 1, "d e f g"), (None, 0, "a")], key=str)
    with pytest.raises(ValueError):
        calls.pieces(rows, lambda t: [], str.split, " ".join, 3, 3)


@pytest.mark.parametrize("parts", [1, 7])
def test_generation_stops_at_its_target(spark, tmp_path, parts):
    def model(texts):
        return [json.dumps([{"question": f"Is this the question number {t.split()[0]} here?", "answer": "yes", "evidence": t[:10]}, {"question": "Always the same question for every chunk?", "answer": "a", "evidence": t[:3]}]) for t in texts]

    chunks = spark.createDataFrame([(i, f"w{i} " + "word " * 150) for i in range(100)] + [(200, "short"), (201, None)], "chunk_id long, text string").repartition(parts)
    got, sent = calls.generated(chunks, logged(f"{tmp_path}/log", model), target=25, wave=10)
    rows = got.collect()
    assert len(rows) == 25 and sent == 30 and sum(map(int, notes(f"{tmp_path}/log", "call"))) == 30
    assert len({r["question"] for r in rows}) == 25 and sum("Always" in r["question"] for r in rows) == 1
    again = calls.generated(chunks.repartition(3), lambda: model, target=25, wave=64)[0].collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
    none, sent = calls.generated(chunks.limit(0), lambda: model, target=5)
    assert (none.count(), sent) == (0, 0)
    few, sent = calls.generated(chunks, lambda: lambda texts: ["no json"] * len(texts), target=5, most=20, wave=10)
    assert (few.count(), sent) == (0, 20)


def test_chunks_keep_ids_and_other_columns(spark):
    rows = [(2**53 + 1, "x", "uno dos\ntres"), (None, "y", "uno"), (2**53 + 1, "z", "cuatro"), (5, None, None), (6, "w", " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, sha string, text string").repartition(2)
    got = sorted(((r["doc_id"], r["sha"], r["segment"], r["chunk"]) for r in chunking.chunked(docs).collect()), key=str)
    assert got == sorted([(2**53 + 1, "x", 0, "uno dos tres"), (None, "y", 0, "uno"), (2**53 + 1, "z", 0, "cuatro")], key=str)
    named = docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert {r["doc_id"] for r in chunking.chunked(named).collect()} == {f"id{2**53 + 1}", None}
    packs = L.packed_sentences(named.withColumn("text", F.lit("Una frase. " * 100)))
    assert packs.where("doc_id is null").count() == 1 and packs.columns == ["doc_id", "sha", "segment", "chunk"]
    whole = chunking.chunked(docs.limit(1).withColumn("text", F.lit("a b c\nd e f\ng h i")), most=8, overlap_ratio=0)
    assert [r["chunk"] for r in whole.orderBy("segment").collect()] == ["a b c d e f", "g h i"]


def test_points_of_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "shaA", "uno"), (1, "shaB", "dos"), (1, "shaB", "dos"), (2, "shaC", "tres")], "doc_id long, sha string, text string")
    got = sorted((r["document_id"], r["sha"], r["chunk"]) for r in L.points(docs, lambda c: F.when(c != "tres", F.array(F.length(c)))).collect())
    assert got == [(1, "shaA", "uno"), (1, "shaB", "dos")]
