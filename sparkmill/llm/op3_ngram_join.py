"""N-gram Jaccard join with several global token orders: documents whose shingle sets are alike, and their groups.

Method:

1.  One pass over the texts gives every document its set of word shingles as 64-bit hashes, its size and a 64-bit key of
    the whole set; equal sets are one class from here on. The same pass counts which shingles stand often near each
    other; the most frequent of them go to the end of the first order (an order may be any, so this loses nothing).
2.  First order: two sets with Jaccard at least t share one of their first n - ceil(t n) + 1 tokens. The tokens of
    these prefixes are dealt to Spark partitions and sorted. Of up to ``SMALL`` classes that share a token all pairs
    are candidates, of more only those with the bucket's leader; size and position filters apply. The leader is the
    class in whose order the token stands first: it has the fewest rarer tokens, as the middle of a group of copies
    has. Ties go by one of LEADERS random orders, which the token chooses.
3.  Every class has a bitmap: bit h(token) flipped for each token. Two bitmaps differ in no more bits than the sets in
    tokens, so a pair that differs in too many is not alike. Sets that are too large for it have a wider one, as wide as
    the set has tokens, which is looked at for the pairs left. For the classes in candidates that pass, the prefixes under
    further orders (the hashes mixed anew) are taken, as 16 bits of each token; only pairs that share a token in every
    order go on, before any text moves. Those are verified on whole sets; verified links give components.
4.  What step 2 left open: in larger buckets, pairs of classes that are not in one component yet. In buckets of very
    many classes one meets only the bands of sizes that its own size and the token's place allow, and a band is met in
    blocks on both sides. Pairs that pass the size, position and bitmap filters go on as in step 3, and the components are
    joined. No link between two components is lost, and links inside a component do not change it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch, words
from .components import components

#: Words of a shingle; links take a Jaccard of THRESHOLD hundredths.
SHINGLE, THRESHOLD = 5, 75
#: Classes that share a token up to which all their pairs are candidates at once.
SMALL = 4
#: Random orders among classes that could lead a larger bucket.
LEADERS = 8
#: Shingles that a task holds at once to see which are frequent.
COUNTED = 1 << 21
#: Frequent shingles that go to the end of the first order.
FREQUENT = 100_000
#: 64-bit words of a bitmap, and how many go along where rows of large buckets meet; sets of more tokens than bits have a wider one.
BITMAP, FIRST_WORDS = 16, 4
#: Orders beside the first.
ORDERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
#: Set sizes that are a band of their own; classes of a band that are met at once.
EXACT, HELD = 32, 4096
#: Rows of ids up to which a table is broadcast (16 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 2_000_000
_PREFIXES = [f"o{i}" for i in range(len(ORDERS))]


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each row, a slice at a time."""
    for lo, _, data, offsets in words.slices(column):
        starts, ends, first = words.bounds(data, offsets, "spaced")
        yield lo, [np.unique(x) for x in words.runs(words.hashes(data, starts, ends), first, SHINGLE)]


def _key(s: np.ndarray) -> int:
    """A hash of the whole set (signed)."""
    with np.errstate(over="ignore"):
        value = words.mix((words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).reshape(1))
    return int(value.view(np.int64)[0])


def _bitmap(s: np.ndarray, bits: int = 64 * BITMAP) -> np.ndarray:
    """Parities of how many tokens fall on each bit; bits: a power of two."""
    at = (words.mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _wide(s: np.ndarray) -> bytes | None:
    """The bitmap of a set that is too large for ``BITMAP`` words: a bit a token, up to the next power of two."""
    return _bitmap(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > 64 * BITMAP else None


_BITS = [f"s{i}" for i in range(BITMAP)]
_SETS = "counted boolean, id long, doc_id long, key long, n long, " + ", ".join(f"{c} long" for c in _BITS) + ", wide binary"


def _may_match(x: str, y: str, words: int = BITMAP) -> str:
    """SQL: whether the bitmaps of x and y, or the first words of them, allow the threshold."""
    differ = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _BITS[:words])
    return f"{100 + THRESHOLD} * ({differ}) <= {100 - THRESHOLD} * ({x}.n + {y}.n)"


def _prefix(n: int) -> int:
    return n - -(-THRESHOLD * n // 100) + 1


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (false, id, doc_id, key, n, bitmaps) of documents (id, text, doc_id) and (true, null, null, token, count) of shingles that a task met more than twice at once."""
    held: list[np.ndarray] = []
    size = 0
    names = ["counted", "id", "doc_id", "key", "n", *_BITS, "wide"]

    def frequent() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n > 2], n[n > 2]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), bool)), none, none, pa.array(token.view(np.int64)), pa.array(n.astype(np.int64)), *[none] * BITMAP, pa.nulls(len(token), pa.binary())], names=names)

    for batch in batches:
        for lo, sets in _sets(batch.column(1)):
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys = np.array([_key(s) for s in sets], dtype=np.int64)
            bits = np.array([_bitmap(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), bool)), batch.column(0).slice(lo, len(sets)), batch.column(2).slice(lo, len(sets)), pa.array(keys), pa.array(n), *(pa.array(b) for b in bits.T), pa.array([_wide(s) for s in sets], pa.binary())], names=names)
            held += sets
            size += int(n.sum())
            if size >= COUNTED:
                yield frequent()
                held, size = [], 0
    if held:
        yield frequent()


def _prefixes(late: np.ndarray, place: np.ndarray):
    """Prefix tokens of every class that a task meets. late: frequent tokens, sorted; place: their places in the order."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(1)):
                out, keys, sizes, places = [], [], [], []
                for s in sets:
                    if not len(s) or (key := _key(s)) in seen:
                        continue
                    seen.add(key)
                    at = np.minimum(np.searchsorted(late, s), max(0, len(late) - 1))
                    often = late[at] == s if len(late) else np.zeros(len(s), dtype=bool)
                    rare, rest = s[~often], s[often]
                    p = _prefix(len(s))
                    if len(rare) < p:
                        rare = np.concatenate([rare, rest[np.argsort(place[at[often]])]])
                    out.append(rare[:p])
                    keys.append(np.full(p, key))
                    sizes.append(np.full(p, len(s)))
                    places.append(np.arange(p))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                        names=["token", "key", "n", "at"],
                    )

    return tokens


def _alike(n1, n2, at1, at2):
    """Size and position filters: whether sets of n1 and n2 tokens may reach the threshold if the shared token at these places is their first."""
    low, high = np.minimum(n1, n2).astype(np.int64), np.maximum(n1, n2).astype(np.int64)
    need = -(-THRESHOLD * (low + high) // (100 + THRESHOLD))
    return (100 * low >= THRESHOLD * high) & (1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1) >= need)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, and each bucket's by class with its leader first, to candidates (a, b), and the rows of larger buckets for later (b null)."""
    cut: list[np.ndarray] | None = None
    parted: int | None = None  # the token of a bucket that was too large to hold

    def one(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, key, n, at = rows
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, n, at = (x[fresh] for x in rows)
        head = np.ones(len(token), dtype=bool)
        head[1:] = token[1:] != token[:-1]
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(token)))
        if parted is not None:
            count = np.where(token[first] == parted, np.maximum(count, SMALL + 1), count)
        of = np.cumsum(head) - 1
        pairs = []
        for step in range(1, SMALL):
            i = np.flatnonzero(np.append(token[step:] == token[:-step], np.zeros(min(step, len(token)), dtype=bool)) & (count[of] <= SMALL)) if len(token) > step else np.zeros(0, np.int64)
            pairs.append((i, i + step))
        large = np.flatnonzero(count[of] > SMALL)
        star = large[~head[large]]
        pairs.append((first[of[star]], star))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        fit = _alike(n[a], n[b], at[a], at[b])
        a, b = a[fit], b[fit]
        seen = np.unique(np.stack([np.minimum(key[a], key[b]), np.maximum(key[a], key[b])]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        none = pa.nulls(seen.shape[1], pa.int64())
        names = ["a", "b", "token", "n", "at"]
        yield pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1]), none, none.cast(pa.int32()), none.cast(pa.int32())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.nulls(len(large), pa.int64()), pa.array(token[large]), pa.array(n[large]), pa.array(at[large])], names=names)

    # A bucket that goes on in the next batch is held back; one too large to hold is cut, and all of it goes to step 4.
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if cut is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(cut, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last == 0 and len(rows[0]) > 1_000_000:
            last, parted = len(rows[0]), int(rows[0][0])
        if last:
            yield from one([x[:last] for x in rows])
        cut = [x[last:] for x in rows]
    if cut is not None and len(cut[0]):
        yield from one(cut)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of those rows (a, b, text_a, text_b) whose sets have these keys and reach the threshold."""

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= THRESHOLD * (len(x) + len(y) - both)

    memory: dict[int, np.ndarray] = {}
    plain = zstandard.ZstdDecompressor()
    text = lambda c: pa.array([plain.decompress(x) for x in c.to_pylist()], pa.binary()).cast(pa.string())
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        fit = []
        for lo, right in _sets(text(batch.column(3))):
            for i, y in enumerate(right, lo):
                x = memory.get(a[i])
                if x is None:
                    x = next(_sets(text(batch.column(2).slice(i, 1))))[1][0]
                    memory = {a[i]: x} if len(memory) > 64 else memory | {a[i]: x}
                if len(x) and len(y) and _key(x) == a[i] and _key(y) == b[i] and similar(x, y):
                    fit.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit, pa.int64())), batch.column(1).take(pa.array(fit, pa.int64()))], names=["u", "v"])


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _wide_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of those rows (a, b, n, x, y), n the tokens of both, whose wider bitmaps allow the threshold, or that lack one; the wider one is folded to the width of the other."""
    for batch in batches:
        fit = []
        for i, (n, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
            if x is None or y is None:
                fit.append(i)
                continue
            both = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, both)) for v in (x, y))
            if (100 + THRESHOLD) * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= (100 - THRESHOLD) * n:
                fit.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(fit, pa.int64())) for c in (0, 1)], names=["a", "b"])


def _fitting(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs whose bitmaps allow the threshold. Of wider ones only those move whose pairs the others leave."""
    x, y = (classes.select(F.col("key").alias(c), F.struct("n", *_BITS).alias(s)) for c, s in (("a", "x"), ("b", "y")))
    left = pairs.join(x, "a").join(y, "b").where(F.expr(_may_match("x", "y")))
    left = scratch.keep(left.select("a", "b", F.expr("x.n + y.n").alias("n"), (F.expr("least(x.n, y.n)") > 64 * BITMAP).alias("large")), "pairs-by-bitmaps")
    large = left.where("large")
    keys = scratch.keep(large.select(F.col("a").alias("key")).union(large.select("b")).distinct(), "large")
    wide = scratch.keep(sets.where("wide is not null").select("key", "wide").join(_sized(keys), "key").dropDuplicates(["key"]), "wide")
    both = large.join(wide.select(F.col("key").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("key").alias("b"), F.col("wide").alias("y")), "b")
    return left.where("not large").select("a", "b").unionByName(both.select("a", "b", "n", "x", "y").mapInArrow(words.released(_wide_match), "a long, b long"))


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, text) that belong together: key, the text compressed, and of each further order the prefix, 16 bits a token."""
    press = zstandard.ZstdCompressor(level=3)
    names = ["key", "text", *_PREFIXES]
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for lo, sets in _sets(batch.column(1)):
            own = [(lo + i, s) for i, s in enumerate(sets) if len(s) and _key(s) == keys[lo + i]]
            heads = []
            for seed in ORDERS:
                of_order = []
                for _, s in own:
                    m, p = words.mix(s ^ np.uint64(seed)), _prefix(len(s))
                    of_order.append(np.unique((np.partition(m, p - 1)[:p] if p < len(m) else m).view(np.uint16)[::4].view(np.int16)))
                heads.append(pa.array(of_order, pa.list_(pa.int16())))
            rows = pa.array([i for i, _ in own], pa.int64())
            texts = [press.compress(t.encode()) for t in batch.column(1).take(rows).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(texts, pa.binary()), *heads], names=names)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) among candidate pairs of class keys; the text of each class is that of its least document."""
    with scratch.steps(docs.sparkSession):
        involved = scratch.keep(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select("key", "rep"), "involved")
        texts = docs.select(F.col("id").alias("rep"), "text").join(_sized(involved), "rep").select("key", "text")
        texts = scratch.keep(texts.mapInArrow(words.released(_pressed), "key long, text binary, " + ", ".join(f"{c} array<smallint>" for c in _PREFIXES)), "texts")
        x, y = (texts.select(F.col("key").alias(c), F.struct(*_PREFIXES).alias(s)) for c, s in (("a", "x"), ("b", "y")))
        shared = F.lit(True)
        for c in _PREFIXES:
            shared = shared & F.arrays_overlap(f"x.{c}", f"y.{c}")
        near = scratch.keep(pairs.join(x, "a").join(y, "b").where(shared).select("a", "b").distinct(), "pairs-by-orders")
        left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")).join(_sized(near), "a")
        both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return scratch.keep(both.mapInArrow(words.released(_verify), "u long, v long"), "verified", stay=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents (doc_id, text; other columns do not matter) linked by a shingle Jaccard of at least 0.75.

    Returns per row: doc_id, n_shingles, component_id (the least doc_id that links reach, the row's own included).
    Words are runs of anything but ASCII white space, A-Z lowered; fewer words than a shingle's are one shingle. Null
    text, empty text and text without words: n_shingles 0, linked with nothing. Equal texts always link. Rows with a
    repeated doc_id each keep their own set; a null doc_id is linked as any other and gets the least id of its group, or
    null where all of that are null.
    """
    with scratch.steps(docs.sparkSession):
        scratch.small_batches(docs.sparkSession)
        doc_id = F.col("doc_id").cast("long")
        # texts are found again by this id; rows without one by a hash, and whoever shares it is told apart by its set
        return _grouped(docs.select(F.coalesce(doc_id, F.xxhash64("text")).alias("id"), "text", doc_id.alias("doc_id")))


def _band(n: Column) -> Column:
    """Bands of set sizes: each of its own up to ``EXACT``, then by a factor of 1.05."""
    return F.when(n <= EXACT, n.cast("int")).otherwise((EXACT + 1 + F.floor(F.log(n / EXACT) / np.log(1.05))).cast("int"))


def _dealt(bucket: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by (token, band, bx, by): the classes outside a bucket's main group, and all of it.

    A bucket of up to ``HELD`` classes is met whole. In a larger one a class of n tokens, the shared one of which stands
    at a place, can only be like sets of certain sizes: no fewer than the threshold's share of n, and so few that what
    comes after the place can reach the overlap asked for. It goes to each of their bands; either side of a band is
    dealt to blocks of some ``HELD`` classes, and goes to all blocks of the other.
    """
    t, zero = THRESHOLD / 100, F.lit(0)
    small = bucket.where(F.col("classes") <= HELD).withColumns({"band": zero, "bx": zero, "by": zero}).drop("classes")
    large = bucket.where(F.col("classes") > HELD).drop("classes")
    low, high = F.ceil(F.col("n") * t - 1e-9), F.floor((F.col("n") - F.col("at")) * (1 + t) / t - F.col("n") + 1e-9)
    few = large.where("group != main").withColumn("band", F.explode(F.when(low <= high, F.sequence(_band(low), _band(high))).otherwise(F.array().cast("array<int>"))))
    all_ = large.withColumn("band", _band(F.col("n")))
    parts = lambda rows, name: rows.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias(name))
    blocks = scratch.keep(parts(few, "nx").join(parts(all_, "ny"), ["token", "band"]), "bands")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    left = few.join(blocks, ["token", "band"]).withColumn("bx", block("nx")).withColumn("by", every("ny"))
    right = all_.join(blocks, ["token", "band"]).withColumn("by", block("ny")).withColumn("bx", every("nx"))
    return small.where("group != main").unionByName(left.select(small.columns)), small.unionByName(right.select(small.columns))


def _grouped(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    seen = scratch.keep(docs.mapInArrow(words.released(_first_pass), _SETS), "sets", stay=True)
    meta = seen.where("not counted")
    tops = seen.where("counted").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    late = np.array([r["key"] for r in tops], dtype=np.int64).view(np.uint64)
    by = np.argsort(late)
    late, place = late[by], -by
    classes = scratch.keep(meta.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"), F.min("n").alias("n"), *(F.min(c).alias(c) for c in _BITS)), "classes")

    shared = spark.sparkContext.broadcast((late, place))
    prefixes = docs.mapInArrow(words.released(lambda it: _prefixes(*shared.value)(it)), "token long, key long, n int, at int")
    found = scratch.keep(prefixes.repartition("token").sortWithinPartitions("token", "at", F.xxhash64("key", F.pmod("token", F.lit(LEADERS)))).mapInArrow(words.released(_buckets), "a long, b long, token long, n int, at int"), "candidates")
    stars = scratch.keep(_fitting(found.where("b is not null").select("a", "b").distinct(), classes, meta), "pairs")
    links = _verified(stars, docs, classes)
    groups = scratch.keep(components(links), "groups")

    rest = found.where("token is not null").select(F.col("a").alias("key"), "token", "n", "at")
    rest = scratch.keep(rest.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "token", "n", "at", F.coalesce("component", "key").alias("group")), "rest")
    size = rest.groupBy("token", "group").agg(F.count(F.lit(1)).alias("n"))
    mixed = scratch.keep(size.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("classes"), F.max(F.struct("n", "group"))["group"].alias("main")).where("groups > 1").drop("groups"), "mixed")
    bucket = scratch.keep(rest.join(mixed, "token").join(classes.select("key", *_BITS[:FIRST_WORDS]), "key"), "mixed-rows")
    x, y = (side.alias(name) for side, name in zip(_dealt(bucket), "xy", strict=True))
    fits = F.expr(
        f"x.token = y.token and x.band = y.band and x.bx = y.bx and x.by = y.by and x.group != y.group and (y.group = y.main or x.key < y.key) and 100 * least(x.n, y.n) >= {THRESHOLD} * greatest(x.n, y.n)"
        f" and ({100 + THRESHOLD}) * (1 + least(x.n - x.at - 1, y.n - y.at - 1)) >= {THRESHOLD} * (x.n + y.n)"
        f" and {_may_match('x', 'y', FIRST_WORDS)}"
    )
    pairs = x.join(y, fits).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    more = scratch.keep(_fitting(pairs, classes, meta).join(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), ["a", "b"], "left_anti"), "open")
    if not more.isEmpty():
        groups = scratch.keep(components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(_verified(more, docs, classes))), "groups")

    named = classes.select("key", "least").join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = scratch.keep(named.join(scratch.keep(least, "least"), "group").select("key", "component_id"), "named", stay=True)
    out = meta.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_ngram_join``: all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), g as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') t
    from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(1, len(w))))) i from d)
), n as (select doc_id, count(*) n from g group by doc_id)
, p as (
    select x.doc_id a, y.doc_id b, count(*) c from g x join g y on x.t = y.t and x.doc_id != y.doc_id group by x.doc_id, y.doc_id
), l as (
    select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)
), r as (
    select doc_id node, doc_id reach from d
    union
    select r.node, l.b from r join l on r.reach = l.a
)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, min(reach)::bigint component_id
from d join r on r.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n
"""
