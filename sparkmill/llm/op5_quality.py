"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text and per-language perplexity thresholds.

The model is one of runs of ORDER whole code points (lower case, digits as 0); its vocabulary has no bound. One pass
over all texts gathers the different runs, and how often each stands in the texts that teach; the counts are summed by
run, discounted and joined with those of their contexts and shorter runs in Spark, each table sharded by its own key.
That gives every run that occurs anywhere its probability. A second pass counts the runs of each document; these counts
are joined with the probabilities and summed to the document's perplexity. A document is kept if its perplexity is not
above its language's threshold, a quantile of trusted documents of that language which did not teach.

Runs are joined by 64-bit hashes of their code points; two share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch, words

#: Code points of a run, and bits of one.
ORDER, BITS = 4, 21
#: Code points there can be: the probability of one that is not known is shared among so many.
SYMBOLS = 0x110000
#: Trusted documents whose crc32(doc_id) this divides do not teach; they set the thresholds.
HELD_OUT = 5
#: Quantile of the held-out trusted documents of a language that is its threshold.
QUANTILE = 0.99
#: Rows up to which a table is broadcast (some 50 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Different runs that a task holds before it passes their counts on.
HELD_RUNS = 1 << 21
#: Characters and rows handled at once.
CHARACTERS, ROWS = 1 << 20, 1 << 10

_MASK = (1 << BITS) - 1
_COEF = np.random.default_rng(5).integers(1, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lowered = np.zeros(0, dtype=np.uint32)


def _lower() -> np.ndarray:
    """For each code point the character that stands for it: lower case, 0 for a digit, a space for white space."""
    global _lowered
    if not len(_lowered):
        table = np.arange(0x110000, dtype=np.uint32)
        table[0] = 0xFFFD  # code 0 stands before a text
        for c in range(0x110000):
            s = chr(c)
            if s.isspace():
                table[c] = 32
            elif s.isdigit():
                table[c] = 48
            elif len(low := s.lower()) == 1:
                table[c] = ord(low)
        _lowered = table
    return _lowered


def _characters(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, characters, row of each from the first)``, a slice at a time; white space is one space, and none at the ends."""
    table = _lower()
    for lo, hi, _, _ in words.slices(column, CHARACTERS, ROWS):
        texts = [" " + (t or "") + " " for t in column.slice(lo, hi - lo).to_pylist()]
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
        c = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        inner = (c != 32) | np.append((c[1:] != 32) & (row[1:] == row[:-1]), False)
        first = np.append(True, row[1:] != row[:-1])
        use = inner & ~(first & (c == 32))
        yield lo, hi, c[use], row[use]


def _counted(c: np.ndarray, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different runs of each group of rows: the groups, the runs as columns of code points, and their counts.

    A slice's code points are numbered, so that group and run fit one integer, which is sorted. Runs of a text longer
    than a slice are counted in parts of it.
    """
    out = []
    for a in range(0, len(c), 1 << 21):
        b = min(len(c), a + (1 << 21))
        begin = max(0, a - ORDER + 1)
        seen = np.zeros(SYMBOLS, dtype=bool)
        seen[c[begin:b]] = True
        seen[0] = True
        alphabet = np.flatnonzero(seen)
        bits = int(len(alphabet)).bit_length()
        number = (np.cumsum(seen) - 1)[c[begin:b]].astype(np.uint64)
        of, at = row[begin:b], group[row[begin:b]]
        columns = []
        for k in range(ORDER - 1, -1, -1):
            before = np.zeros(b - begin, dtype=np.uint64)
            before[k:] = np.where(of[k:] == of[: len(of) - k], number[: len(of) - k], 0)
            columns.append(before[a - begin :])
        at = at[a - begin :].astype(np.uint64)
        if ORDER * bits + int(at.max(initial=0)).bit_length() <= 64:
            key = at
            for x in columns:
                key = (key << np.uint64(bits)) | x
            key, n = np.unique(key, return_counts=True)
            runs = [alphabet[((key >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in range(ORDER - 1, -1, -1)]
            at = (key >> np.uint64(ORDER * bits)).astype(np.int64) if ORDER * bits < 64 else np.zeros(len(key), np.int64)
        else:
            table, n = np.unique(np.stack([at, *columns]), axis=1, return_counts=True)
            at, runs = table[0].astype(np.int64), [alphabet[x.astype(np.int64)] for x in table[1:]]
        out.append((at, np.stack(runs), n))
    if not out:
        return np.zeros(0, np.int64), np.zeros((ORDER, 0), np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x, axis=-1) for x in zip(*out, strict=True))


def _hash(runs: np.ndarray) -> np.ndarray:
    return words.mix((runs.astype(np.uint64) * _COEF[:, None]).sum(axis=0, dtype=np.uint64)).view(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, taught): the different runs with their counts in taught texts, 0 for those of other texts alone."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        runs, n = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        _, first, own = np.unique(_hash(runs), return_index=True, return_inverse=True)
        return runs[:, first], np.bincount(own, weights=n, minlength=len(first)).astype(np.int64)

    def passed(runs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        context = runs[0] << (2 * BITS) | runs[1] << BITS | runs[2]
        return pa.RecordBatch.from_arrays([pa.array(_hash(runs)), pa.array(context), pa.array(runs[3]), pa.array(n)], names=["h", "context", "symbol", "n"])

    for batch in batches:
        taught = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, c, row in _characters(batch.column(0)):
            at, runs, n = _counted(c, row, taught[lo:hi])
            held.append((runs, n * at))
            size += len(n)
            if size > HELD_RUNS:
                held = [summed()]
                size = len(held[0][1])
                if size > HELD_RUNS // 2:
                    yield passed(*held[0])
                    held, size = [], 0
    if held:
        yield passed(*summed())


def gathered(texts: DataFrame) -> DataFrame:
    """All different runs of texts (text, taught): h, context (of ORDER - 1 code points), symbol, n (their count in taught texts)."""
    parts = texts.select("text", "taught").mapInArrow(words.released(_gather), "h long, context long, symbol long, n long")
    return parts.groupBy("h", "context", "symbol").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> Column:
    """The discount of a count n, from how many runs occur once, twice, three and four times."""
    n1, n2, n3, n4 = counts.agg(*(F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4))).head()
    n1, n2, n3, n4 = (x or 0 for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [i - (i + 1) * y * b / a if a else y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    one, two, three = (min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))
    return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(three)


def _shorter(k: int) -> Column:
    """The context of a run of k code points without its first."""
    return F.col("context").bitwiseAND((1 << (BITS * (k - 2))) - 1) if k > 2 else F.lit(0).cast("long")


def kneser_ney(runs: DataFrame) -> DataFrame:
    """(h, log_p) of every run of :func:`gathered`.

    Shorter runs count the different code points before them. A run that was not taught, or whose context was not,
    leaves its weight to the shorter one, at last to all ``SYMBOLS`` code points alike.
    """
    levels = {ORDER: scratch.keep(runs.where("n > 0").select("context", "symbol", "n"), "taught-runs")}
    wanted = {ORDER: runs.select("context", "symbol")}
    for k in range(ORDER, 1, -1):
        levels[k - 1] = scratch.keep(levels[k].groupBy(_shorter(k).alias("context"), "symbol").agg(F.count(F.lit(1)).alias("n")), "taught-runs")
        wanted[k - 1] = scratch.keep(wanted[k].select(_shorter(k).alias("context"), "symbol").distinct(), "wanted-runs")
    q = None
    for k in range(1, ORDER + 1):
        level = levels[k].withColumn("d", _discounts(levels[k]))
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("rest"))
        own = wanted[k].join(level, ["context", "symbol"], "left").join(contexts, "context", "left")
        if q is None:
            own = own.withColumn("q", F.lit(1 / SYMBOLS))
        else:
            own = own.withColumn("shorter", _shorter(k)).join(q, ["shorter", "symbol"])
        p = F.coalesce((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("q")
        p = scratch.keep(own.select("context", "symbol", p.alias("p")), "probabilities")
        q = p.select(F.col("context").alias("shorter"), "symbol", F.col("p").alias("q"))
    return runs.select("h", "context", "symbol").join(p, ["context", "symbol"]).select("h", F.log("p").alias("log_p"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (row, text): the different runs of each with their counts."""
    for batch in batches:
        for lo, hi, c, row in _characters(batch.column(1)):
            at, runs, n = _counted(c, row, np.arange(hi - lo))
            for a in range(0, len(n), 1 << 18):
                part = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + at[part])), pa.array(_hash(runs[:, part])), pa.array(n[part])], names=["row", "h", "n"])


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def perplexities(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(row, n, perplexity) of texts (row, text) by a model (h, log_p) of all their runs; texts without characters have no row.

    Rows with an equal key are one text, of which n counts the characters as often as it stands there.
    """
    counted = texts.select("row", "text").mapInArrow(words.released(_count), "row long, h long, n long")
    sums = counted.join(_sized(model), "h").groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("log_p")).alias("log_p"))
    return sums.select("row", "n", F.exp(-F.col("log_p") / F.col("n")).alias("perplexity"))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Judge docs (doc_id, text, lang; other columns do not matter) by a model of those that labels (doc_id, quality) trust.

    Returns per row: doc_id, lang, n_symbols, perplexity, threshold, kept. Trusted are documents with quality 1; null or
    repeated labels do not matter. A language's threshold is the quantile of its trusted documents that did not teach;
    where there are none, of all its trusted ones, else of all its documents (a null lang is a language of its own).
    Null or empty text: n_symbols 0, perplexity null, not kept. Repeated rows each get the same result; those of one
    doc_id with different texts are judged each for itself. Without any trusted text all code points are equally likely.
    """
    with scratch.steps(docs.sparkSession):
        scratch.small_batches(docs.sparkSession)
        good = scratch.keep(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True)), "trusted")
        own = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("row")).join(_sized(good), "doc_id", "left")
        learner = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT != 0
        own = own.withColumn("taught", F.coalesce(F.col("trusted") & learner, F.lit(False)))
        runs = scratch.keep(gathered(own), "runs")
        model = scratch.keep(kneser_ney(runs), "model")
        found = scratch.keep(perplexities(own, model), "perplexities")
        narrow = own.drop("text")
        copies = narrow.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
        found = found.join(copies, "row").select("row", (F.col("n") / F.col("copies")).cast("long").alias("n_symbols"), "perplexity")
        scored = scratch.keep(narrow.join(found, "row", "left"), "scored", stay=True)
        at = lambda c: F.percentile_approx(c, quantile, 10_000)
        judges = (F.when(F.col("trusted") & ~F.col("taught"), F.col("perplexity")), F.when(F.col("trusted"), F.col("perplexity")), F.col("perplexity"))
        limits = scored.groupBy(F.col("lang").alias("of")).agg(F.coalesce(*map(at, judges)).alias("threshold"))
        limits = _sized(scratch.keep(limits, "thresholds", stay=True))
        out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
        kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
        return out.select("doc_id", "lang", F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"), "perplexity", "threshold", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_quality``: all documents, trusting those labelled good."""
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
