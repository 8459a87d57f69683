"""Tables written in one step, messages by patterns, Markdown as HTML, document files, links, prompts and dates."""

import json

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.functions.html import html_of, inline, rendered
from sparkmill.operators import indexing as X, messages, records as Q
from sparkmill.sources import commits, documents, html as H


def answers(spark, rows):
    return spark.createDataFrame([(i, u, [(k, f"c{i}{k}") for k in range(n, 0, -1)]) for i, u, n in rows], "id long, user_id long, fragments array<struct<ranking:int,chunk:string>>")


def test_two_tables_in_one_step(spark, tmp_path, monkeypatch):
    root, schema = f"file://{tmp_path}/s", "id long, chunk string, ranking int"
    assert commits.table(spark, root, "bridge", schema).count() == 0
    assert commits.persist_answers(root, "a", answers(spark, [(1, 7, 12), (2, None, 3), (3, 8, 0)]))
    assert sorted(r["id"] for r in commits.table(spark, root, "answers", "id long").collect()) == [1, 3]
    assert [(r["id"], r["ranking"]) for r in commits.table(spark, root, "bridge", schema).orderBy("ranking").collect()] == [(1, k) for k in range(1, 11)]
    assert not commits.persist_answers(root, "a", answers(spark, [(9, 9, 9)]))  # sent again

    written = []

    def failing(self, path, *a, **k):
        written.append(path)
        if len(written) == 2:
            raise OSError("disk")
        return parquet(self, path, *a, **k)

    writer = type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(OSError):
        commits.persist_answers(root, "b", answers(spark, [(4, 9, 2)]))
    monkeypatch.setattr(writer, "parquet", parquet)
    assert len(written) == 2 and commits.table(spark, root, "answers", "id long").count() == 2  # the old state
    assert commits.persist_answers(root, "b", answers(spark, [(4, 9, 2)]))
    assert commits.table(spark, root, "answers", "id long").count() == 3 and commits.table(spark, root, "bridge", schema).count() == 12


def test_of_two_writers_one_fails(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    commits.commit(root, "a", {"t": spark.range(1)})
    folder = commits._Folder(spark, root)
    with pytest.raises(RuntimeError, match="version 0"):
        folder.publish(0, {"tables": {}, "batches": []})
    assert commits.table(spark, root, "t", "id long").count() == 1 and commits.committed(spark, root)["batches"] == ["a"]


def test_messages(spark):
    patterns = spark.createDataFrame([(2, "a(?P<x>.*)", "long"), (1, "ab(?P<x>.*)", "short"), (1, "ab(?P<y>c)?.*", "later"), (0, None, "none")], "seq int, pattern string, key string")
    rows = spark.createDataFrame([("abc", 1), ("ac", 2), ("xabc", 3), (None, 4), ("a\nb", 5), ("abc", 6)], "message string, key int")
    got = sorted(((r["message"] or "", r["key"], r["args"]) for r in messages.matched(rows, patterns).collect()), key=str)
    assert got == sorted([("abc", "short", {"x": "c"})] * 2 + [("ac", "long", {"x": "c"}), ("xabc", None, {}), ("", None, {}), ("a\nb", None, {})], key=str)
    assert messages.matched(rows, patterns.limit(0)).where("key is not null").count() == 0
    texts = spark.createDataFrame([("es", "short", "corto {x}"), ("en", "short", "s {x}"), ("en", "long", "l {x} {z}"), ("en", "xabc", "known")], "language string, key string, text string")
    shown = {r["message"]: r["shown"] for r in messages.localized(rows, patterns, texts, "es", "en").collect()}
    assert shown == {"abc": "corto c", "ac": "l {x} {z}", "xabc": "known", None: None, "a\nb": "a\nb"}


@pytest.mark.parametrize(
    ("markdown", "want"),
    [
        ("", ""),
        ("a\nb\n\nc", "<p>a<br>b</p><p>c</p>"),
        ("# a\n#### b\n##### c\n#d", "<h3>a</h3><h6>b</h6><p>##### c<br>#d</p>"),
        ("x\n# \ny", "<p>x</p><p>#<br>y</p>"),
        ("- a\n* b\n+ c\nd", "<ul><li>a</li><li>b</li><li>c</li></ul><p>d</p>"),
        ("1. a\n2) b\n- c", "<ol><li>a</li><li>b</li></ol><ul><li>c</li></ul>"),
        ("> a\n>b\nc", "<blockquote>a<br>b</blockquote><p>c</p>"),
        ("```py\n<x>\n# no\n```\nafter", '<pre class="rag-code-block"><code>&lt;x&gt;\n# no</code></pre><p>after</p>'),
        ("```\nopen\n\n- x", '<pre class="rag-code-block"><code>open\n\n- x</code></pre>'),
        ("```", '<pre class="rag-code-block"><code></code></pre>'),
        ("x\n```py z\ny", "<p>x</p><p>```py z<br>y</p>"),
        ("a | b\n---|---\n1 | 2\n- 3 | *4*\nend", '<div class="rag-table-wrap"><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>- 3</td><td><em>4</em></td></tr></tbody></table></div><p>end</p>'),
        ("a | b\nno rule", "<p>a | b<br>no rule</p>"),
        ("<script>alert('x')</script>", "<p>&lt;script&gt;alert(&#39;x&#39;)&lt;/script&gt;</p>"),
        ("**a** __b__ *c* _d_ `**e** <f>`", "<p><strong>a</strong> <strong>b</strong> <em>c</em> <em>d</em> <code>**e** &lt;f&gt;</code></p>"),
        ("a\r\nb\rc", "<p>a<br>b<br>c</p>"),
    ],
)
def test_markdown_as_html(markdown, want):
    assert rendered(markdown) == want


def test_html_of_columns(spark):
    rows = spark.createDataFrame([("# a",), (None,), ("x " * 500_000,)], "t string")
    got = [r["h"] for r in rows.select(html_of(F.col("t")).alias("h")).collect()]
    assert got[:2] == ["<h3>a</h3>", ""] and len(got[2]) == 999_999 + 7
    assert inline('"\0"') == "&quot;&quot;"


def test_document_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in {"b.pdf": b"Title\none\ftwo\f", "deep/a.pdf": b"\nonly", "bad.pdf": b"\xff\xfe", "none.pdf": b"x", "c.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    parser = "page_parser:lines_of_pages"
    rows = documents.pages(spark, str(tmp_path), parser)
    assert rows.rdd.getNumPartitions() == 4
    got = sorted(((r["name"], r["title"], r["pages"], r["page"], r["text"], (r["error"] or "")[:16]) for r in rows.collect()), key=str)
    assert got == sorted([("a.pdf", "", 1, 1, "only", ""), ("b.pdf", "Title", 3, 1, "one", ""), ("b.pdf", "Title", 3, 2, "two", ""), ("b.pdf", "Title", 3, 3, "", ""), ("bad.pdf", None, None, None, None, "UnicodeDecodeErr"), ("none.pdf", None, None, None, None, "ValueError: no p")], key=str)
    whole = documents.whole(rows).collect()
    assert [(r["name"], r["title"], r["pages"], r["text"]) for r in whole[:2]] == [("a.pdf", "a", 1, "only"), ("b.pdf", "Title", 3, "one\ntwo")]
    assert [r["error"] is None for r in whole] == [True, True, False, False]
    thin = documents.pages(spark, str(tmp_path), "no.such:parser", columns="name string, size long")
    assert sorted((r["name"], r["size"]) for r in thin.collect()) == [("a.pdf", 5), ("b.pdf", 14), ("bad.pdf", 2), ("none.pdf", 1)]
    assert documents.pages(spark, str(tmp_path), parser, "*.docx").count() == 0


def test_parser_that_only_the_driver_finds(spark, tmp_path, monkeypatch):
    for folder in ("code", "files"):
        (tmp_path / folder).mkdir()
    (tmp_path / "code" / "parser_of_driver.py").write_text("def pages(data):\n    return 'T', data.decode().split('|')\n")
    (tmp_path / "files" / "a.pdf").write_bytes(b"one|two")
    monkeypatch.syspath_prepend(str(tmp_path / "code"))
    rows = documents.pages(spark, str(tmp_path / "files"), "parser_of_driver:pages").collect()
    assert sorted((r["title"], r["page"], r["text"], r["error"]) for r in rows) == [("T", 1, "one", None), ("T", 2, "two", None)]


def test_labelled_links(spark):
    page = '<a href="/1">pliego PRESCRIPCIONES  técnicas</a><a href="/2">Pliego Prescripciones Técnicas</a><a>Pliego Cláusulas Administrativas</a><a href="/3">Pliego Cláusulas Administrativas</a>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, '<a href="">Pliego Prescripciones Técnicas</a>')], "page_id long, html string")
    assert [tuple(r) for r in H.labelled_links(rows).collect()] == [(1, "Pliego Prescripciones Técnicas", "/1")]


def test_prompts_dates_and_json(spark):
    rows = spark.createDataFrame([("nonsense", "q", ["a"]), (None, None, None), ("budget", "{context}", ["x", "y"])], "p string, q string, b array<string>")
    got = [r["t"] for r in rows.select(X.profile_prompt(F.col("p"), F.col("q"), F.col("b"), template="{task}|{range}|{question}|{context}").alias("t")).collect()]
    general = X.PROFILE_TASKS["general"]
    assert got == [f"{general}|CHUNK #1|q|a", f"{general}|-||", f"{X.PROFILE_TASKS['budget']}|CHUNK #1-2|{{context}}|x\ny"] and len(X.PROFILE_TASKS) == 11
    days = spark.createDataFrame([("2024-02-09", " x\n"), (None, None)], "d string, s string").select(F.col("d").cast("date").alias("d"), "s")
    assert [tuple(r) for r in days.select(T.day_shown(F.col("d")), T.month_shown(F.col("d"), "es"), T.trimmed(F.col("s"))).collect()] == [("09/02/2024", "Febrero 2024", "x"), ("-", "", "")]
    nested = spark.createDataFrame([({1: [{"v": float("nan"), "w": None}]}, None), (None, [[1.5, float("inf")]])], "a map<int,array<struct<v:double,w:string>>>, b array<array<float>>")
    texts = [json.loads(r["j"]) for r in nested.select(Q.json_text(nested, F.struct("a", "b")).alias("j")).collect()]
    assert texts == [{"a": {"1": [{"v": None, "w": None}]}, "b": None}, {"a": None, "b": [[1.5, None]]}]
