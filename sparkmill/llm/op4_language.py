"""Language ID by hyperdimensional profiles.

Every letter has a random +1/-1 vector. A trigram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a document bundles (adds) its trigrams' vectors, a language the unit vectors of its training
documents. A text gets the language whose prototype is nearest by cosine.

Tasks count the trigrams of whole texts and multiply these counts with the vectors of the trigrams that the slice
holds; a language's prototype is a sum of integers over Spark partitions, so it is the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch, words

#: Components of a vector, letters of an n-gram, and the scale at which unit vectors become integers.
DIMENSIONS, GRAM, SCALE = 1024, 3, 1 << 20
#: Documents whose crc32(doc_id) leaves this remainder by 3 are held out of training.
HELD_OUT = 1
#: Five standard deviations of the cosine of unrelated vectors; the quantile of training scores taken where these are lower.
NOISE, LOWEST = 5 / DIMENSIONS**0.5, 0.001
#: Vectors of trigrams that a worker remembers (1 KB each), trigrams and texts that are multiplied at once, and characters of a text.
REMEMBERED, GRAMS, ROWS, CHARACTERS = 16_384, 4096, 256, 1 << 19

_LETTER = np.zeros(0x110000, dtype=np.uint32)
_memory: dict[int, int] = {}
_vectors = np.zeros((0, DIMENSIONS), dtype=np.int8)


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for anything else."""
    if not _LETTER.any():
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                _LETTER[c] = ord(low) if len(low) == 1 else c
    return _LETTER


def _letter_vector(c: int, place: int) -> np.ndarray:
    """The vector of a letter (a space for 0), rotated by its place."""
    rng = np.random.default_rng([7, c])
    return np.roll(rng.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1, place)


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of at most ``GRAMS`` trigrams."""
    global _vectors
    if not len(_vectors):
        _vectors = np.empty((REMEMBERED, DIMENSIONS), dtype=np.int8)
    new = [g for g in grams.tolist() if g not in _memory]
    if len(_memory) + len(new) > REMEMBERED:
        _memory.clear()
        new = grams.tolist()
    letters: dict[tuple[int, int], np.ndarray] = {}
    for i, g in enumerate(new, len(_memory)):
        _vectors[i] = 1
        for place in range(GRAM):
            k = ((g >> (21 * place)) & 0x1FFFFF, place)
            if k not in letters:
                letters[k] = _letter_vector(*k)
            _vectors[i] *= letters[k]
    _memory.update(zip(new, range(len(_memory), len(_memory) + len(new)), strict=True))
    return _vectors[[_memory[g] for g in grams.tolist()]].astype(np.float32)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``CHARACTERS``, cut at what is no letter: no trigram has that in its middle."""
    at = 0
    while len(text) - at > CHARACTERS:
        end = at + CHARACTERS
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different trigrams of the texts, and for each occurrence its number among these and its text."""
    texts = [f" {t} " for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    use = np.ones(len(letters), dtype=bool)
    use[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (row[1:] != row[:-1])
    letters, row = letters[use].astype(np.int64), row[use]
    gram = letters[:-2] | letters[1:-1] << 21 | letters[2:] << 42
    fit = (row[:-2] == row[2:]) & (letters[1:-1] > 0) if len(letters) > 2 else np.zeros(0, dtype=bool)
    kinds, at = np.unique(gram[fit], return_inverse=True)
    return kinds, at, row[:-2][fit]


def bundles(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, document vectors)``, a slice at a time; a text without letters has the zero vector.

    Letters are lowered; between them, and at both ends, whatever is no letter is one space.
    """
    for lo, hi, _, _ in words.slices(column, CHARACTERS, ROWS):
        texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        for part in [texts] if len(texts) > 1 else ([p] for p in _parts(texts[0])):
            kinds, at, row = _counted(part)
            for a in range(0, len(kinds), GRAMS):
                width = min(GRAMS, len(kinds) - a)
                own = (at >= a) & (at < a + GRAMS)
                counts = np.bincount(row[own] * width + at[own] - a, minlength=len(texts) * width)
                out += counts.reshape(len(texts), width).astype(np.float32) @ _gram_vectors(kinds[a : a + width])
        yield lo, out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language a task meets: the sum of its documents' unit vectors, as integers."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lo, out in bundles(batch.column(0)):
            norm = np.linalg.norm(out.astype(np.float64), axis=1)
            unit = np.rint(out / np.maximum(norm, 1e-12)[:, None] * SCALE).astype(np.int64)
            own = np.array(langs[lo : lo + len(out)])
            for lang in set(own.tolist()):
                total[lang] = total.get(lang, 0) + unit[(own == lang) & (norm > 0)].sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit prototypes, from (text, lang); a null lang teaches nothing."""
    scratch.small_batches(docs.sparkSession)
    parts = docs.where("lang is not null").select("text", "lang").mapInArrow(words.released(_train), "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v"))
    rows = sorted((r["lang"], r["v"]) for r in sums.collect())  # a row a language
    vectors = np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), DIMENSIONS)
    norm = np.linalg.norm(vectors, axis=1)
    keep = norm > 0
    return [lang for (lang, _), k in zip(rows, keep, strict=True) if k], vectors[keep] / norm[keep, None]


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The columns of docs, lang_pred and score: the nearest prototype and its cosine, not below 0.

    ``und`` and 0 where text is null or has no letter, and everywhere if nothing was learned. Of equal cosines the
    first language by name is taken. Repeated rows each get the same result. Columns of docs that have these names are
    replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vectors = shared.value
        for batch in batches:
            for lo, out in bundles(batch.column(names.index("text"))):
                out = out.astype(np.float64)
                norm = np.linalg.norm(out, axis=1)
                cosine = out @ vectors.T / np.maximum(norm, 1e-12)[:, None] if langs else np.zeros((len(out), 1))
                best = cosine.argmax(axis=1)
                lang = [langs[b] if n > 0 and langs else "und" for b, n in zip(best, norm, strict=True)]
                score = np.where(norm > 0, np.clip(cosine[np.arange(len(out)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(out)).columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(words.released(predict), f"{fields}, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept out of training; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == HELD_OUT, F.lit(True))


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for every row of docs (doc_id, text, lang and more) from prototypes of those that are not held out."""
    return predicted(docs, prototypes(docs.where(~held_out(F.col("doc_id")))))


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of :func:`identified` whose text is like what was learned, with lang_pred and score.

    A cosine under ``NOISE`` says no more than that of unrelated texts, so such a text goes, unless training documents
    about as long, predicted rightly, score as low: then their ``LOWEST`` quantile is the limit. So a long text in an
    unlearned script or of random letters goes, and a clean one of a few letters stays if such were learned.
    """
    found = scratch.keep(identified(docs).where("lang_pred != 'und' and score > 0"), "identified", stay=True)
    about = F.floor(F.log2(F.length("text"))).cast("int")
    learned = found.where(~held_out(F.col("doc_id")) & (F.col("lang") == F.col("lang_pred")))
    limits = learned.groupBy(about.alias("__about")).agg(F.percentile_approx("score", LOWEST, 10000).alias("__limit"))
    limits = F.broadcast(scratch.keep(limits, "limits", stay=True))  # a row a power of two
    judged = found.join(limits, about == F.col("__about"), "left").where(F.col("score") >= F.least("__limit", F.lit(NOISE)))
    return judged.drop("__about", "__limit")


def query(spark, sf_dir: str) -> DataFrame:
    """``op4_language``: all documents, trained on those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = prototypes(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
