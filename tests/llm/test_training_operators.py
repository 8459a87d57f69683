"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_words_and_codes import brute_kneser_ney, brute_perplexity
from tokenizers import Tokenizer

import corpus_pipeline
from sparkmill.llm import op1_url_filter as op1, op2_license as op2, op3_ngram_join as op3, op4_language as op4, op5_quality as op5, op6_nn_descent as op6, op7_line_dedup as op7, op8_token_file as op8, op9_packing as op9, op10_decontamination as op10, scratch, tokens, words
from sparkmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, linked):
    head = {n: n for n in nodes}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(7, 7), (100, 99), (99, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_filter(spark):
    urls = ["https://a.com/x", "http://www.example.com/en/1", "http://blog.Example.COM/en/1?x", "http://q.net/fr/a", "http://q.net", None, "nothing", "ftp://h.org#a/b", "http://acom/en/", "http://good.org/1", "http://bad.org/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = spark.createDataFrame([("http://bad.org/9", False)] * 60 + [("http://good.org/9", True)] * 60 + [("http://bad.org/9", None), (None, True)], "url string, good boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in op1.judged(pages, labelled).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("blog.example.com", "/en/1", "example.com/en/", "block")
    assert got[3] == ("q.net", "/fr/a", "net/fr/", "block")
    assert got[4] == ("q.net", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("h.org", "", None, "allow")
    assert got[8][2] is None
    assert (got[9][3], got[10][3]) == ("allow", "block")
    nothing = spark.createDataFrame([], "url string, good boolean")
    assert {r["verdict"] for r in op1.judged(pages, nothing).collect()} == {"allow", "block"}
    assert op1.judged(pages.limit(0), labelled).count() == 0


def test_url_filter_of_hosts_without_outcomes(spark):
    """A new host of a bad domain is blocked, one of a good or an unknown domain is not; equally long rules and repeated rows."""
    labelled = [(f"http://h{i % 40}.bad.org/{i}", False) for i in range(400)] + [(f"http://h{i % 40}.good.org/{i}", True) for i in range(400)] + [(f"http://x{i}.com.au/", i % 2 == 0) for i in range(40)]
    urls = ["http://new.bad.org/x", "http://new.good.org/x", "http://new.other.org/", "http://nobody.zz/", "http://h1.bad.org/", "http://new.bad.org/x", "http://" + "a" * 100_000 + ".bad.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    table = spark.createDataFrame(labelled, "url string, good boolean")
    got = [(r["page_id"], r["verdict"]) for r in op1.judged(pages, table).collect()]
    assert sorted(got) == [(0, "block"), (0, "block"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "block"), (5, "block"), (6, "block")]
    tied = (("bad.org/a", "allow"), ("bad.org/b", "block"), ("bad.org/", "block"))
    rule = {r["path"]: r["rule"] for r in op1.judged(spark.createDataFrame([(1, "http://q.bad.org/a"), (2, "http://q.bad.org/c")], "page_id long, url string"), table, tied).collect()}
    assert rule == {"/a": "bad.org/a", "/c": "bad.org/"}


def test_license(spark):
    files = [
        (1, "r", "LICENSE", "Licensed under the Apache License, Version 2.0.\nmore"),
        (2, "r", "a/b/x.txt", "nothing here"),
        (3, "r", "a/COPYING", "Released under the MIT License"),
        (4, "r", "a/b/c/y.txt", None),
        (5, "q", "a/b/x.txt", ""),
        (6, "r", "z.txt", "x\nLicensed under CC BY-NC 4.0"),
        (7, None, None, "MIT License"),
        (8, "r", "w.txt", "the license"),
    ]
    table = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, repo string, path string, text string, licence string")
    got = {r["file_id"]: (r["own"], r["inherited"], r["licence"]) for r in op2.licensed(table).collect()}
    assert got[1] == ("Apache-2.0", "Apache-2.0", "Apache-2.0")
    assert got[2] == (None, "MIT", "MIT")
    assert got[4] == (None, "MIT", "MIT")
    assert got[5] == (None, None, None)
    assert got[6] == ("CC-BY-NC-4.0", "Apache-2.0", "CC-BY-NC-4.0")
    assert got[8] == (None, "Apache-2.0", "Apache-2.0")
    assert op2.licensed(table.limit(0)).count() == 0


def test_license_of_rows_with_one_name_and_other_texts(spark):
    mit = op2.TEMPLATES["MIT"]
    files = spark.createDataFrame([(1, "r", "a/x.py", mit), (1, "r", "a/x.py", None), (1, "r", "a/x.py", "nothing"), (1, "r", "a/x.py", mit)], "file_id long, repo string, path string, text string")
    assert sorted(str(r["own"]) for r in op2.licensed(files).collect()) == ["MIT", "MIT", "None", "None"]


def test_license_headers_wrapped_and_inside_lines(spark):
    bsd = op2.TEMPLATES["BSD-3-Clause"].split()
    texts = [
        "# Copyright\n# The ASF licenses this file to You under the Apache\n# License, Version 2.0 (the\n# licence)\ncode",
        "\n".join(" * " + " ".join(bsd[i : i + 6]) for i in range(0, len(bsd), 6)),
        "We are glad to say it is now Released under the MIT License and everyone may use it",
        "A source form of public version terms, code",
        "word " * 50_000 + "Licensed under CC BY-NC 4.0 " + "word " * 50_000,
        "MIT MIT MIT MIT MIT",
        "released under the\nMIT\nlicense released under the MIT license",
    ]
    table = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(texts)], "file_id long, repo string, path string, text string")
    table = table.union(table.where("file_id = 1"))
    rows = op2.licensed(table).collect()
    got = {r["file_id"]: r["own"] for r in rows}
    assert len(rows) == 8
    assert [got[i] for i in range(7)] == ["Apache-2.0", "BSD-3-Clause", "MIT", None, "CC-BY-NC-4.0", None, "MIT"]

    def plain(text):
        model = op2.Model(op2.TEMPLATES, op2.THRESHOLD)
        terms = re.findall("[a-z0-9]+", text.lower())
        best = 0
        for i, n in enumerate(model.lengths):
            for a in range(max(1, len(terms) - n + 1)):
                run = terms[a : a + n]
                value = {t: run.count(t) * model.shares.get(t, (model.other,))[0] for t in run}
                norm = sum(x * x for x in value.values()) ** 0.5
                best = max(best, sum(x * model.shares[t][1][i] for t, x in value.items() if t in model.shares) / norm)
        return best

    for r in rows:
        if r["file_id"] != 4:
            best = plain(texts[r["file_id"]])
            assert (r["own"] is None and best < op2.THRESHOLD) or abs(r["score"] - best) < 1e-8


def test_ngram_join_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(vocabulary[:14])
    texts = [None, "", " \n", "one two", "One  two", "x", "shared " * 50]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((line + " " if rng.random() < 0.5 else "") + " ".join(copy))
    texts += texts[-3:]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    sets = [shingles(t) for t in texts]
    want = groups(range(len(texts)), lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_ngram_join_of_a_mesh_of_copies(spark):
    """Copies of one text that are less alike to each other than to it: larger buckets, pairs left open by the stars."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.025 else f"e{rng.random()}" for w in base) for _ in range(60)]
    docs = documents(spark, texts)
    sets = [shingles(t) for t in texts]
    want = groups(range(60), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in op3.near_duplicates(docs).collect()}
    assert got == want


def test_ngram_join_of_null_ids_and_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, far = text + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(6, text), (5, near), (None, near + " still"), (None, far), (None, far + " x"), (8, far + " x y"), (8, "other words of a text"), (None, "own words of a text alone"), (None, None), (None, "")]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3.near_duplicates(table).collect()), key=str)
    assert got == sorted([(6, 56, 5), (5, 57, 5), (None, 58, 5), (None, 56, 8), (None, 57, 8), (8, 58, 8), (8, 1, 8), (None, 2, None), (None, 0, None), (None, 0, None)], key=str)


def test_ngram_join_of_unlike_documents_with_common_tokens(spark, monkeypatch):
    """Tokens in the prefixes of 20,000 unlike documents: few pairs are made of them, and in blocks."""
    common = "one two three four five six seven"
    texts = [f"{common} own{i}" for i in range(20_000)] + [f"{common} eight nine ten eleven twelve end{i}" for i in range(40)]
    table = documents(spark, texts).repartition(4)
    monkeypatch.setattr(op3, "HELD", 512)
    seen = {}
    keep = scratch.keep
    monkeypatch.setattr(op3.scratch, "keep", lambda df, what, *a, **k: seen.setdefault(what, keep(df, what, *a, **{**k, "stay": True})) if what in ("mixed-rows", "bands") else keep(df, what, *a, **k))
    got = {r["doc_id"]: r["component_id"] for r in op3.near_duplicates(table).collect()}
    assert all(got[i] == i for i in range(20_000))
    assert {got[i] for i in range(20_000, 20_040)} == {20_000}
    x, y = op3._dealt(seen["mixed-rows"])
    blocks = x.groupBy("token", "band", "bx", "by").agg(F.count(F.lit(1)).alias("a")).join(y.groupBy("token", "band", "bx", "by").agg(F.count(F.lit(1)).alias("b")), ["token", "band", "bx", "by"])
    assert (blocks.agg(F.max(F.col("a") * F.col("b"))).head()[0] or 0) <= (2 * 512) ** 2
    scratch.clear(spark)


def test_ngram_join_of_long_unlike_documents_moves_no_text(spark, monkeypatch):
    """Long texts that share phrases only: the bitmaps exclude their pairs, before orders and texts move."""
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}x{i}" for i in range(8)) for k in range(200)]
    texts = [" ".join([*(f"t{d}x{i}" for i in range(3000)), *phrases]) for d in range(7)]
    copy = texts[0].split(" ")
    for _ in range(40):
        copy[rng.randrange(3000)] = f"e{rng.random()}"
    seen = {}
    keep = scratch.keep
    monkeypatch.setattr(op3.scratch, "keep", lambda df, what, *a, **k: (got := keep(df, what, *a, **k), seen.setdefault(what, []).append(got.count()))[0])
    got = {r["doc_id"]: r["component_id"] for r in op3.near_duplicates(documents(spark, [*texts, " ".join(copy)]).repartition(8)).collect()}
    assert got == {i: i for i in range(7)} | {7: 0}
    assert sum(seen["pairs-by-bitmaps"]) > 10 and sum(seen["involved"]) == 2


def test_ngram_join_of_nothing(spark):
    assert op3.near_duplicates(documents(spark, []).limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (None, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in op3.near_duplicates(odd).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1)]


def test_language(spark):
    rng = random.Random(6)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    rows = [(i, make(["th", "he", "ing"]), "en") for i in range(60)] + [(100 + i, make(["çé", "eau", "oi"]), "fr") for i in range(60)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 %% 3", "fr"), (303, "the ing", None), (304, "THE HEING THHE " * 4000, "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in op4.identified(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert {got[i]["lang_pred"] for i in (300, 301, 302)} == {"und"} and got[302]["score"] == 0
    assert got[304]["lang_pred"] == "en" and 0 < got[304]["score"] <= 1
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", op4.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    empty = op4.identified(docs.limit(0))
    assert empty.count() == 0 and op4.predicted(docs.limit(3), ([], np.zeros((0, op4.DIMENSIONS)))).head()["lang_pred"] == "und"


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["the", "there", "other", "then"]) for _ in range(20))
    texts = [good() for _ in range(40)] + ["%%$$ ###!! " * 9, None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(3, 1), (40, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in op5.classified(docs, labels).collect()}
    assert sum(got[i]["kept"] for i in range(40)) >= 37
    assert not got[40]["kept"] and got[40]["perplexity"] > 10 * got[0]["perplexity"]
    assert got[41]["perplexity"] is None and not got[42]["kept"]
    nobody = op5.classified(docs, labels.limit(0)).where("perplexity is not null").select(F.round("perplexity", 3).alias("p")).distinct().collect()
    assert [r["p"] for r in nobody] == [float(0x110000)]
    assert op5.classified(docs.limit(0), labels).count() == 0


def test_quality_against_brute_force(spark):
    """Perplexity, thresholds from trusted documents that did not teach, and the verdict; foreign scripts are told from a repeated letter."""
    rng = random.Random(4)
    text = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 12)))
    rows = [(i, text(["ba", "na", "to"]), "x") for i in range(60)] + [(100 + i, text(["ru", "ki"]), "y") for i in range(40)] + [(200 + i, text(["ξε", "ρα", "ф"]), "x") for i in range(6)] + [(300, "a" * 60, "x"), (301, "ba na", None), (302, None, "x"), (303, "", "z"), (304, "some text", "z")]
    rows += rows[:3]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, perplexity double")
    trusted = {i for i in range(50)} | {100 + i for i in range(30)}
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(60, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    got = op5.classified(docs, labels, 0.9).collect()
    assert len(got) == len(rows)
    teaches = lambda i: i in trusted and zlib.crc32(str(i).encode()) % 5 != 0
    prob = brute_kneser_ney([t for i, t, _ in rows if teaches(i)])
    value = {i: brute_perplexity(prob, t) if t else None for i, t, _ in rows}
    limit = {}
    for lang in {r[2] for r in rows}:
        for pool in (lambda i: i in trusted and not teaches(i), lambda i: i in trusted, lambda i: True):
            known = sorted(value[i] for i, _, k in rows if k == lang and pool(i) and value[i] is not None)
            if known:
                limit[lang] = known[-(-9 * len(known) // 10) - 1]
                break
    for r in got:
        i = r["doc_id"]
        assert r["perplexity"] == (value[i] if value[i] is None else pytest.approx(value[i], rel=1e-9))
        assert r["threshold"] == pytest.approx(limit[r["lang"]], rel=1e-9)
        assert r["kept"] == (value[i] is not None and value[i] <= limit[r["lang"]] * (1 + 1e-12))
    assert not any(r["kept"] for r in got if 200 <= r["doc_id"] <= 300)
    assert len({round(r["perplexity"]) for r in got if 200 <= r["doc_id"] <= 300}) == 7


def test_nn_descent_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([centres, centres[rng.integers(0, 6, 160)] + 0.12 * rng.standard_normal((160, 16)), centres[:5], 2 * centres[:3]])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, []), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    want = groups(range(len(x)), lambda a, b: link[a, b])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op6.near_duplicates(table).collect()}
    for i in range(len(x)):
        assert got[i] == (int(link[i].sum()) - 1, want[i], want[i] == i)
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert op6.near_duplicates(table.limit(0)).count() == 0


def test_nn_descent_of_a_hub_and_a_chain(spark, monkeypatch):
    """A vector with very many links that do not link with each other, vectors linked one to the next only, a repeated id, ties."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    away = rng.standard_normal((300, 64))
    spokes = 0.956 * centre + np.sqrt(1 - 0.956**2) * unit(away - (away @ centre)[:, None] * centre)
    chain = [unit(rng.standard_normal(64))]
    for _ in range(150):
        new = rng.standard_normal(64)
        chain.append(0.966 * chain[-1] + np.sqrt(1 - 0.966**2) * unit(new - (new @ chain[-1]) * chain[-1]))
    x = np.concatenate([[centre], spokes, chain, chain[:2], unit(rng.standard_normal((200, 64)))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows + [(5, rows[7][1])], "vec_id long, embedding array<double>")
    link = x @ x.T >= 0.95
    want = groups(range(len(x)), lambda a, b: link[a, b])
    report = {}
    monkeypatch.setattr(op6, "TILE", 64)
    monkeypatch.setattr(op6, "STRIPE", 10)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in op6.near_duplicates(table, report).collect()]
    counts = link.sum(axis=1) - 1 + link[:, 7]
    assert sorted(got) == sorted([(i, int(counts[i]), want[i]) for i in range(len(x))] + [(5, int(counts[7]), want[7])])
    assert report["recall"] >= 0.98 and counts[0] >= 300
    monkeypatch.setattr(op6, "_recall", lambda *_: 0.97)
    monkeypatch.setattr(op6, "EXTRA", 0)
    with pytest.raises(RuntimeError, match="recall"):
        op6.near_duplicates(table)


def _turned(centre, towards, degrees):
    """A unit vector at an angle from a centre, towards another vector."""
    side = towards - (towards @ centre) * centre
    angle = np.radians(degrees)
    return np.cos(angle) * centre + np.sin(angle) * side / np.linalg.norm(side)


def _checked_nn_descent(spark, x):
    """Rows against all pairs."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    want = groups(range(len(x)), lambda a, b: link[a, b])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op6.near_duplicates(table, report).collect()}
    assert got == {i: (int(link[i].sum()) - 1, want[i]) for i in range(len(x))}
    return len(set(want.values()))


def test_nn_descent_of_a_bridge_between_dense_groups(spark):
    """300 vectors around each of two centres that are too far apart, and one vector between them that links with all."""
    rng = np.random.default_rng(11)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    b = _turned(a, b, 21.57)
    near = lambda c: [_turned(c, rng.standard_normal(64), 0.2) for _ in range(300)]
    assert _checked_nn_descent(spark, np.array([*near(a), *near(b), _turned(a, b, 5)])) == 1


def test_nn_descent_of_a_chain_of_dense_groups(spark):
    """Three groups; each neighbouring two are joined by one pair of vectors only, found among far more that do not link."""
    rng = np.random.default_rng(12)
    a, b, c = np.linalg.qr(rng.standard_normal((64, 3)))[0].T
    b = _turned(a, b, 22)
    c = _turned(b, c, 22)
    near = lambda m: [_turned(m, rng.standard_normal(64), 0.2) for _ in range(150)]
    joins = [_turned(a, b, 2.2), _turned(b, a, 2.2), _turned(b, c, 2.2), _turned(c, b, 2.2)]
    others = rng.standard_normal((100, 64))
    assert _checked_nn_descent(spark, np.array([*near(a), *near(b), *near(c), *joins, *others])) == 101


def test_line_dedup(spark):
    passage = "\n".join(f"line {i} of a passage that many documents share" for i in range(60))
    texts = [f"a\nb\n{passage}\nc", f"x {1}\n{passage}\ny", f"q\nr\ns\n{passage}", "alone\nhere", None, "", "\n\n", "\n\n", "w " * 60, "w " * 60]
    docs = documents(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r["doc_id"]: r for r in op7.without_repeats(docs).collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_removed"] == 0
    assert [(got[i]["text"], got[i]["n_removed"]) for i in (1, 2)] == [("x 1\ny", 60), ("q\nr\ns", 60)]
    assert [got[i]["text"] for i in (3, 4, 5, 6, 7, 8, 9)] == ["alone\nhere", None, "", "\n\n", "\n\n", "w " * 60, ""]
    assert op7.without_repeats(docs.limit(0)).count() == 0


def test_line_dedup_of_passages_between_own_lines(spark):
    rng = random.Random(3)
    texts, shared = [], {n: "\n".join(" ".join(f"p{n}x{i}y{k}" for k in range(-(-60 // n))) for i in range(n)) for n in (1, 2, 3, 6)}
    shared[4] = "\n".join(["a4 " * 30, "", "short", "b4 " * 30])  # its middle is in no window of its own
    for copy in range(6):
        for passage in shared.values():
            texts.append(f"own {rng.random()}\nline {rng.random()}\n{passage}\nnext {rng.random()}\nlast {rng.random()}")
    texts += [None, "", "\n\n", "few words\ntwice", "y " * 30 + "\n" + "z " * 10, "other\n" + "y " * 30]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in op7.without_repeats(docs.union(docs.where("doc_id = 7"))).collect()}
    want = {i: t for i, t in enumerate(texts)}
    for i in range(len(shared), 6 * len(shared)):
        lines = texts[i].split("\n")
        want[i] = "\n".join(lines[:2] + lines[-2:])
    assert {i: r["text"] for i, r in got.items()} == want
    assert all((got[i]["n_removed"] > 0) == (want[i] != texts[i]) for i in want)
    assert op7.without_repeats(docs.limit(0)).count() == 0


def test_line_dedup_of_a_long_text_and_repeated_rows(spark):
    long = "\n".join(f"line {i} of a text" for i in range(60_000))
    docs = documents(spark, [long, "own\n" + long, "same\nlines"])
    docs = docs.union(docs.where("doc_id = 2")).union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in op7.without_repeats(docs).collect())
    assert got == [(False, 0, "same\nlines"), (True, 0, long), (True, 1, "own"), (True, 2, ""), (True, 2, "")]


def test_line_dedup_of_lines_with_one_hash(spark, monkeypatch):
    """Lines whose hash stands for different texts are left alone."""
    docs = documents(spark, ["a b\nc d\n" + "x " * 60, "a b\nc d\n" + "x " * 60, "e f\n" + "y " * 60, "e f\n" + "y " * 60]).withColumn("__row", F.col("doc_id"))
    plain = {r["doc_id"] for r in op7._repeated(docs).collect()}
    odd = spark.range(1).select(F.xxhash64(F.lit("x " * 60)).alias("h"))
    monkeypatch.setattr(op7, "_ambiguous", lambda *_: odd)
    left = {r["doc_id"]: [tuple(x) for x in r["__runs"]] for r in op7._repeated(docs).collect()}
    assert plain == {1, 3} and (1 not in left or all(first + lines <= 2 for first, _, lines in left[1])) and 3 in left


def test_shared_folder_is_left_empty(spark, monkeypatch, tmp_path):
    """Tables between steps go by themselves, those that results read when they are cleared; a cluster needs a shared folder."""
    scratch.clear(spark)
    root = scratch.root
    monkeypatch.setattr(scratch, "root", lambda _: f"file://{tmp_path}")
    docs = documents(spark, ["a b c d e f g\nh i\nj k", "a b c d e f g\nh i\nj k", "x\ny " * 40])
    with scratch.steps(spark):
        got = op7.without_repeats(docs)
        groups_ = op3.near_duplicates(docs)
        assert got.count() == groups_.count() == 3
        assert 0 < len(list(tmp_path.iterdir())) <= 5
    assert not list(tmp_path.iterdir())
    op7.without_repeats(docs).count()
    scratch.clear(spark)
    assert not list(tmp_path.iterdir())

    class Cluster:
        conf, sparkContext = {}, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        root(Cluster)


def test_the_session_keeps_its_batch_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7777")
    docs = documents(spark, ["some words of a text", "x"])
    op3.near_duplicates(docs).collect()
    op9.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert spark.conf.get(key) == "7777"
    spark.conf.set(key, before)
    scratch.clear(spark)


def test_long_words_and_texts_in_parts(monkeypatch):
    data = np.frombuffer(("aB " * 50 + "x" * 300 + " yz").encode(), dtype=np.uint8)
    starts, ends, _ = words.bounds(data, np.array([0, len(data)]), "spaced")
    whole = words.hashes(data, starts, ends)
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    assert (words.hashes(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 3
    text = "Über straße, " * 200 + "z" * 90
    one = next(op4.bundles(pa.array([text])))[1]
    monkeypatch.setattr(op4, "CHARACTERS", 50)
    assert (next(op4.bundles(pa.array([text])))[1] == one).all()


def test_language_against_plain_bundles(spark, monkeypatch):
    """Bind, permute, bundle and cosine, written out."""
    monkeypatch.setattr(op4, "REMEMBERED", 8)
    monkeypatch.setattr(op4, "GRAMS", 4)
    texts = {i: t for i, t in enumerate(["the cat sat", "le chat noir", "the  Dog!", "un chien", "", None, "12 34", "the", "chat", "the cat sat", "ça va", "x"])}
    langs = ["en", "fr", "en", "fr", "en", "fr", None, "en", "fr", "en", "", "en"]

    def vector(text):
        out = np.zeros(op4.DIMENSIONS)
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            word = f" {word} "
            for i in range(len(word) - 2):
                bound = np.ones(op4.DIMENSIONS)
                for place, c in enumerate(word[i : i + 3]):
                    bound = bound * np.roll(op4._letter_vector(0 if c == " " else ord(c), 0), place)
                out += bound
        return out

    docs = spark.createDataFrame([(i, texts[i], langs[i]) for i in texts] * 2, "doc_id long, text string, lang string")
    sums: dict = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 3 != 1 and langs[i] is not None and (v := vector(t)).any():
            sums[langs[i]] = sums.get(langs[i], 0) + v / np.linalg.norm(v)
    for r in op4.identified(docs).collect():
        v = vector(r["text"])
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosine = {k: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for k, s in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r["lang_pred"] == best and abs(r["score"] - max(0, cosine[best])) < 1e-5


def test_token_file(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["It's  a test.\n\nOf <|endoftext|> spaces ", "<|endoftext|>at the  <|endoftext|>\n ends<|endoftext|>", "in<|endoftext|>side <|ENDOFTEXT|> <|endoftext|><|endoftext|>", None, "", "Über façade naïve 漢字 " * 300, "a" * 5000, " x", "same", "same"]
    docs = spark.createDataFrame([(7 * ((5 * i) % 12), t, 1) for i, t in enumerate(texts)] + [(None, "none", 1)], "doc_id long, text string, start int")
    op8.write(docs, f"file://{tmp_path}/f", path)
    model = Tokenizer.from_file(path)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    found = {r["doc_id"]: r for r in op8.read(spark, f"file://{tmp_path}/f").collect()}
    short = {r["doc_id"]: r["ids_crc32"] for r in op8.read(spark, f"file://{tmp_path}/f", digest=True).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[doc_id]["start"], found[doc_id]["n_tokens"], found[doc_id]["ids"]) == (start, len(ids), ids)
        assert short[doc_id] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    op8.write(docs.limit(0), f"file://{tmp_path}/e", path)
    assert op8.read(spark, f"file://{tmp_path}/e").count() == 0


def test_pieces_end_with_their_letters():
    """A word is encoded once, whatever follows it; the ids are those of the whole text."""
    rng = random.Random(9)
    odd = ["it's", "'sword", "don't.", "x'", "a1b2", "3rd,", "e.g.", "--w--", "é,", "né.e", "a\u0301,", "e\u0301'll", "A'S", "\x00a\x00", "we'll!!", "_a_b"]
    texts = ["".join(rng.choice([rng.choice(odd), " ", "\n ", "  ", "abc"[: rng.randrange(4)], ",", "'", "9"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    for name, byte_level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        model = tokens.Coder(public_tokenizers.path(name), byte_level)
        for lo, hi, data, offsets in words.slices(pa.array(texts)):
            ids, n = model.encode(data, offsets, 2)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*model.model.encode(t, add_special_tokens=False).ids, 2] for t in texts[lo:hi]]
        model = tokens.Coder(public_tokenizers.path(name), byte_level)
        for *_, data, offsets in words.slices(pa.array([f" {w}{i}" for i in ",.;:!?)" for w in ("one", "two", "three", "four", "five")])):
            model.encode(data, offsets, 2)
        assert len(model.keys) == 12  # and not 35


def test_letters_beyond_ascii_are_words_too():
    """Letters after one space or none go to the library's model alone; the ids are those of the whole text."""
    rng = random.Random(10)
    letters = [chr(c) for c in [*range(0xC0, 0x280), *range(0x400, 0x480)]]
    texts = [f"{c}, {c}{c}\n{c}.\r\n{c}1 \t{c}\n\n{c} \n{c}'s\x0b{c}a{c}- A{c}I{c}\n'{c} {c}" for c in letters]
    odd = ["×", "÷", "İ", "ŉ", "ǅ", "ß", "a\u0301", "\u0301", "ё", "Й", "\u0482", "\u0483", "ª", "²", "Ω", "\u0300", "漢字", "\U0001F600", "\x85", "\u2028", "\x1c", "'s", "'LL", "<|endoftext|>"]
    texts += ["".join(rng.choice([rng.choice(odd), rng.choice(letters), " ", "\n", "\r\n", "  ", "\t", "ab", "é", ",", "'", "9"]) for _ in range(rng.randrange(60))) for _ in range(600)]
    for name, byte_level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        model = tokens.Coder(public_tokenizers.path(name), byte_level)
        for lo, hi, data, offsets in words.slices(pa.array(texts)):
            ids, n = model.encode(data, offsets, 2)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*model.model.encode(t, add_special_tokens=False).ids, 2] for t in texts[lo:hi]]
        model = tokens.Coder(public_tokenizers.path(name), byte_level)
        for *_, data, offsets in words.slices(pa.array([f"a\n{w}{i} {w}" for i in ",.;:!?)" for w in ("été", "día", "schön", "её", "né")])):
            model.encode(data, offsets, 2)
        assert len(model.keys) == (19 if byte_level else 13)  # each word with and without a space, the seven signs, the others
        assert (model.words is not None) == byte_level


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "A b\tc\n d", "word " * 5000, "x y z " * 300, "Ünï <|endoftext|> 'll", "<|startoftext|>a<|ENDOFTEXT|> <|endoftext|>", "<|ENDOFTEXT|> <|Startoftext|>", "x y z " * 300]
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    model = Tokenizer.from_file(path)
    got = op9.packed(docs, path, with_ids=True).collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i // 2, a // 2048, a, ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids"]) for r in got) == sorted(want)
    by: dict = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) == -(-sum(len(w[3]) for w in want) // 2048)
    assert op9.packed(docs.limit(0), path).count() == 0


def test_decontamination(spark):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "only three words"), (3, None), (4, "..."), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "only three words"), (None, "a b c d e f g h i j")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    eleven = "x ALPHA, beta gamma delta epsilon-zeta eta theta iota kappa lambda y"
    texts = [eleven, "only three", "Only, three: WORDS! and only three words", None, "", "alpha beta gamma delta epsilon zeta eta theta iota", "only\nthree words"]
    docs = documents(spark, texts).withColumn("items", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in op10.contamination(docs, bench).collect()}
    assert got[0] == (13, 11, ["1", "10"])
    assert got[1] == (2, 0, [])
    assert got[2] == (7, 6, ["2"])
    assert got[3] == got[4] == (0, 0, [])
    assert got[5][1] == 0
    assert got[6] == (3, 3, ["2"])
    clean = {r["doc_id"]: r["text"] for r in op10.contamination(docs, bench, clean=True).collect()}
    assert clean[0] == "x  y" and clean[2] == "! and " and clean[3] is None and clean[5] == texts[5]
    assert {r["n_hit"] for r in op10.contamination(docs, bench.limit(0)).collect()} == {0}
    assert op10.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten item{i}") for i in range(40)], "item_id int, text string")
    docs = documents(spark, ["one two three four five six seven eight nine ten"])
    whole = op10.contamination(docs, bench).head()
    monkeypatch.setattr(op10, "ITEM_BYTES", 300)
    assert op10.contamination(docs, bench).head() == whole and len(whole["items"]) == 40


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(5)
    text = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(text[a : a + 14])) for i, a in enumerate(rng.sample(range(380), 30))]  # most overlap with others
    bench += [(100 + i, " ".join([*text[a - 5 : a], *text[a + 10 : a + 15]])) for i, a in enumerate((50, 150))]  # not there until words are cut
    bench = spark.createDataFrame(bench, "item_id int, text string")
    docs = documents(spark, [" ".join(text), " ".join(text[:60]), "own words " * 20 + " ".join(text[200:260]), None, "", "w1 w2", " ".join(text)])
    whole = sorted(op10.contamination(docs, bench).collect())
    cut = sorted(op10.contamination(docs, bench, clean=True).select("doc_id", F.coalesce("text", F.lit("-"))).collect())
    for size in (2000, 700):
        monkeypatch.setattr(op10, "ITEM_BYTES", size)
        assert len(list(op10._blocks(bench))) > 1
        assert sorted(op10.contamination(docs, bench).collect()) == whole
        assert sorted(op10.contamination(docs, bench, clean=True).select("doc_id", F.coalesce("text", F.lit("-"))).collect()) == cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_pipeline_language_rejects_what_was_not_learned(spark, folder):
    rng = random.Random(9)
    alphabets = ["".join(map(chr, range(a, b))) for a, b in ((0x3B1, 0x3CA), (0x430, 0x450), (0x4E00, 0x5200))] + ["abcdefghijklmnopqrstuvwxyz"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = docs.where("text rlike '[A-Za-zÀ-ÿ]'")
    made = [(10**6 + i, " ".join("".join(rng.choices(alphabets[i % 4], k=rng.randint(2, 9))) for _ in range(120))) for i in range(80)]
    made = [i for i in made if zlib.crc32(str(i[0]).encode()) % 3 == op4.HELD_OUT]  # not learned from
    other = spark.createDataFrame(made, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    kept = corpus_pipeline.language_id(spark, docs.unionByName(other.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))), folder)
    assert len(made) > 15 and kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in clean.collect()}


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, folder).toPandas())
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.count() <= before.count()
        if name == "language_id":
            assert docs.count() == before.where("text rlike '[A-Za-zÀ-ÿ]'").count()
        if name == "near_dedup":
            texts = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            want = groups(list(texts), lambda a, b: texts[a] and 100 * len(texts[a] & texts[b]) >= 75 * len(texts[a] | texts[b]))
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            assert {r["n_hit"] for r in op10.contamination(docs, bench).collect()} == {0}
            assert docs.where("n_chars != length(text)").count() == 0
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_pipeline_keeps_rows_not_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (5, text + " more"), (5, "quite another text of its own"), (5, "quite another text of its own"), (None, text + " x"), (None, "one without an id"), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, text), (5, "quite another text of its own"), (None, "one without an id"), (7, None), (7, None)], key=str)
    scratch.clear(spark)


def test_pipeline_stages_on_odd_rows(spark, folder, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing extra columns, and tables without rows."""
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("n_removed", "component_id", "score", "text_md5", "length", "items")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40").withColumns({c: F.lit("clash") for c in names})
    odd = [(None, None, None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n\n ", None, "s", 4), (903, "12 34", "en", None, 5), (None, docs.head()["text"], "en", "s", None)]
    rows = spark.createDataFrame(odd, DOCS).withColumns({c: F.lit(None).cast("string") for c in names})
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(rows.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns)))
    whole = docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, whole.limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), "stage", stay=True)
        if name != "packing":
            assert docs.columns == whole.columns
            assert docs.where("doc_id < 40 and score != 'clash'").count() == 0
    assert 0 < docs.select("doc_id").distinct().count() <= 41
    scratch.clear(spark)
