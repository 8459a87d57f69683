"""Power-of-two decomposition against plain cuts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkmill.llm import op13_binary_packing as op13

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(n, capacity):
    """Cuts of a document of n tokens, the longest first."""
    out, at = [], 0
    while at < n:
        size = capacity
        while size > n - at:
            size //= 2
        out.append((at, size))
        at += size
    return out


def test_decomposed():
    counts = np.array([1, 2, 3, 7, 8, 1023, 1024, 1025, 4095, 10_000])
    row, start, length = op13.decomposed(counts)
    for i, n in enumerate(counts):
        own = row == i
        assert list(zip(start[own], length[own], strict=True)) == plain(n, 1024)
    assert [len(x) for x in op13.decomposed(counts[:0])] == [0, 0, 0]


@pytest.mark.parametrize("capacity", [1, 16, 1024])
def test_sequences_against_the_library(spark, capacity):
    texts = [None, "", "a", "It's  a test.\n\nOf <|endoftext|> spaces ", "word " * 4000, "x y z " * 300, "Über façade naïve 漢字 " * 300, "x y z " * 300]
    docs = spark.createDataFrame([(i // 2 if i else None, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, length string, sequence_id int").repartition(3)
    model = Tokenizer.from_file(PATH)
    want = []
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i // 2 if i else -1, a, n, ids[a : a + n], len(ids)) for a, n in plain(len(ids), capacity)]
    got = op13.sequences(docs, PATH, capacity=capacity, with_ids=True).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids"], r["doc_tokens"]) for r in got) == sorted(want)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got) and not any(r["offset"] for r in got)
    assert all(r["length"].bit_count() == 1 and r["length"] <= capacity for r in got)


def test_batches_hold_equal_lengths_and_every_sequence_once(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 37)) for i in range(200)], "doc_id long, text string").repartition(2)
    cut = op13.sequences(docs, PATH, capacity=64, with_ids=True).cache()
    ids = {r["sequence_id"]: r["ids"] for r in cut.collect()}
    seen = []
    for b in op13.batches(cut, 256).collect():
        n = b["length"]
        assert len(b["ids"]) == n * len(b["sequence_ids"]) <= 256
        for k, name in enumerate(b["sequence_ids"]):
            assert b["ids"][k * n : (k + 1) * n] == ids[name]
            seen.append(name)
    assert sorted(seen) == sorted(ids)
    cut.unpersist()


def test_nothing_and_wrong_capacities(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert op13.sequences(docs, PATH).count() == 0
    assert op13.batches(op13.sequences(docs, PATH, with_ids=True)).count() == 0
    with pytest.raises(ValueError):
        op13.sequences(docs, PATH, capacity=1000)
