"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

Method:

1.  Equal vectors are one class. The first graph joins what lies near each other when sorted by the sign pattern and
    the value of random projections, ``TREES`` times over.
2.  Each round, the neighbours of every node, and those that have it as neighbour, are compared with each other, and
    every node keeps its nearest, until a round adds few edges. A node whose list is full of links (cosine at least
    THRESHOLD) is saturated; its list doubles, from its own last length, until it holds something else or ``MOST``.
    Edges further than twice the threshold's angle lead to no link that a closer path does not, so they are not followed.
3.  The threshold edges give components. A node that is saturated still keeps a second list, of its nearest nodes in
    other components, which is refined by the same rounds; links found so join components, and this goes on until none
    does. So nodes of dense groups find links that their own group would hide.
4.  Inside a component every class is then compared with every other in tiles of a bounded size, so a saturated node's
    links are complete however many they are.
5.  A bounded sample of vectors is held against all vectors by brute force. While its recall is below ``RECALL``,
    new projections and rounds are added, with longer lists; the recall is logged, and a search that stays below ends
    in an error.

Cosines are computed in double precision from the stored components.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch
from .components import components

THRESHOLD = 0.95
#: Length of a neighbour list at first and at most; projections in the first graph; rows compared at once.
NEIGHBOURS, MOST, TREES, BLOCK = 8, 32, 6, 192
#: A round that adds no more than this share of new edges is the last before the audit; at most so many rounds.
FEW, ROUNDS = 0.01, 6
#: Classes in a tile at least and at most, between them 4 times the root of the component's, and rows that are multiplied at once.
LEAST_TILE, TILE, STRIPE = 64, 8192, 1024
#: Vectors in the audit, the recall it asks for, and how often the search goes on until it is reached.
AUDITED, RECALL, EXTRA = 200, 0.98, 6
#: Parts into which the edges of a node are dealt before its nearest are chosen.
PARTS = 64

_log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _prepare(with_vectors: bool):
    """(vec_id, size, k1, k2): its number of components and a 128-bit key of them, null for a vector that links with nothing; and the vector itself."""
    names = ["vec_id", "size", "k1", "k2"] + ["v"] * with_vectors

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if x is None or not len(x) or not np.isfinite(x).all() or not 0 < np.linalg.norm(x) < np.inf:
                    out.append((None, None, None))
                else:
                    key = hashlib.md5(x.tobytes(), usedforsecurity=False).digest()
                    out.append((len(x), *np.frombuffer(key, dtype=np.int64).tolist()))
            size, k1, k2 = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch.column(0), pa.array(size, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * with_vectors, names=names)

    return prepare


def _projected(trees: int, seed: int, names: list[str]):
    """Rows (id, size, v and more) with, for each projection, its number, the signs and the value."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                x = _unit(_matrix(part.column(2)))
                for t in range(trees):
                    planes = np.random.default_rng([seed, t, int(n)]).standard_normal((int(n), 13))
                    y = x @ planes
                    code = ((y[:, :12] > 0) @ (1 << np.arange(12))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), t), pa.int32()), pa.array(code), pa.array(y[:, 12])], names=[*names, "tree", "code", "at"])

    return project


def _near(ids: np.ndarray, x: np.ndarray, floor: float, most: int, apart: np.ndarray | None = None) -> list[np.ndarray]:
    """(u, v, cosine) of each row's nearest ``most`` others at ``floor`` or more; only those with another value of ``apart``."""
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    if apart is not None:
        cosine[apart[:, None] == apart[None, :]] = -2
    most = min(most, len(ids) - 1)
    if most < 1:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    best = np.argpartition(-cosine, most - 1, axis=1)[:, :most]
    row = np.repeat(np.arange(len(ids)), most)
    value = cosine[row, best.ravel()]
    fit = value >= floor
    return [ids[row[fit]], ids[best.ravel()[fit]], value[fit]]


def _edges(u: list, v: list, c: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(c))], names=["u", "v", "cosine"])


def _apart(t: pa.Table) -> np.ndarray | None:
    return t.column("component").to_numpy() if "component" in t.column_names else None


def _windows(floor: float):
    """Sorted rows to edges among those within a block, between components if the rows have these; blocks overlap by half."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
            size = t.column("size").to_numpy()
            for n in np.unique(size):
                own = t.filter(pa.array(size == n)).combine_chunks()
                u, v, c = _near(own.column("id").to_numpy(), _unit(_matrix(own.column("v").combine_chunks())), floor, NEIGHBOURS, _apart(own))
                yield _edges([u], [v], [c])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > BLOCK:
                yield from block(held.slice(0, BLOCK))
                held = held.slice(BLOCK // 2)
        if held is not None and held.num_rows > 1:
            yield from block(held)

    return compare


def _joined(floor: float, most: int):
    """Rows (node, id, size, v) sorted by node: edges among the vectors of each node, between components if the rows have these."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            node, ids, size = (t.column(c).to_numpy() for c in ("node", "id", "size"))
            cut = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (size[1:] != size[:-1])))
            out: list[list] = [[], [], []]
            x, apart = t.column("v").combine_chunks(), _apart(t)
            for a, b in zip(cut, np.append(cut[1:], len(node)), strict=True):
                if b - a > 1:
                    for o, y in zip(out, _near(ids[a:b], _unit(_matrix(x.slice(a, b - a))), floor, most, None if apart is None else apart[a:b]), strict=True):
                        o.append(y)
            if out[0]:
                yield _edges(*out)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            node = held.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last:
                yield from groups(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from groups(held)

    return compare


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, i, j, tile, id, n, v) sorted by the first three: for each id, the vectors of classes linked with it in this pair of tiles."""
    held: pa.Table | None = None

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("component", "i", "j")], axis=1)
        tile, ids, n = (t.column(c).to_numpy() for c in ("tile", "id", "n"))
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        x = t.column("v").combine_chunks()
        out_ids, out_n = [], []
        for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True):
            y, i, j = _unit(_matrix(x.slice(a, b - a))), key[a, 1], key[a, 2]
            left, right = np.flatnonzero(tile[a:b] == i), np.flatnonzero(tile[a:b] == j)
            back = np.zeros(len(right), dtype=np.int64)
            for at in range(0, len(left), STRIPE):
                some = left[at : at + STRIPE]
                linked = (y[some] @ y[right].T) >= THRESHOLD
                if i == j:
                    linked[np.arange(len(some)), np.arange(at, at + len(some))] = False
                else:
                    back += n[a:b][some] @ linked
                out_ids.append(ids[a:b][some])
                out_n.append(linked @ n[a:b][right])
            if i != j:
                out_ids.append(ids[a:b][right])
                out_n.append(back)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["id", "linked"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("component", "i", "j")], axis=1)
        last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        if last:
            yield from groups(held.slice(0, last))
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield from groups(held)


def _best(edges: DataFrame, lengths: DataFrame | None, length: int) -> DataFrame:
    """Each node's nearest neighbours: ``length`` of them, or as many as ``lengths`` (u, length) says, at most ``MOST``.

    They are chosen within ``PARTS`` parts of a node's edges first, so that a node with very many is no single task.
    """
    edges = edges.groupBy("u", "v").agg(F.max("cosine").alias("cosine")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    for keys in (["u", "part"], ["u"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cosine"), "v"))
        edges = edges.withColumn("rank", rank).where(F.col("rank") <= (length if lengths is None else max(length, MOST)))
    if lengths is not None:
        edges = edges.join(lengths, "u", "left").where(F.col("rank") <= F.coalesce("length", F.lit(length)))
    return edges.select("u", "v", "cosine")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))


def _first_graph(vectors: DataFrame, seed: int, floor: float) -> DataFrame:
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    rows = vectors.mapInArrow(_projected(TREES, seed, vectors.columns), f"{kind}, tree int, code int, at double")
    rows = scratch.keep(rows, "projected")
    rows = rows.repartitionByRange("tree", "code", "at").sortWithinPartitions("tree", "code", "at")
    return rows.mapInArrow(_windows(floor), "u long, v long, cosine double")


def _around(graph: DataFrame, length: int) -> DataFrame:
    """(node, id): each node, its neighbours and the nearest of those that have it as neighbour."""
    near = graph.select(F.col("u").alias("node"), F.col("v").alias("id"))
    back = _best(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"), None, length).select(F.col("u").alias("node"), F.col("v").alias("id"))
    return near.union(back).union(near.select("node", F.col("node").alias("id"))).distinct()


def _compared(vectors: DataFrame, around: DataFrame, floor: float, most: int) -> DataFrame:
    rows = around.join(vectors, "id").select("node", *vectors.columns).repartition("node").sortWithinPartitions("node", "size")
    return rows.mapInArrow(_joined(floor, most), "u long, v long, cosine double")


def _round(vectors: DataFrame, graph: DataFrame, floor: float, length: int) -> DataFrame:
    """The graph and what its neighbours-of-neighbours joins add."""
    return graph.unionByName(_compared(vectors, _around(graph, length), floor, 2 * length))


def _next(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, id): for each node the neighbours in ``then`` of its neighbours in ``first``."""
    return first.select(F.col("u").alias("node"), F.col("v").alias("u")).join(then.select("u", F.col("v").alias("id")), "u").select("node", "id")


def _settled(graph: DataFrame, before: DataFrame) -> bool:
    return graph.join(before, ["u", "v"], "left_anti").count() <= FEW * before.count()


def _bridged(vectors: DataFrame, graph: DataFrame, links: DataFrame, floor: float, seed: int) -> DataFrame:
    """The components (node, component) of the links and of those that saturated nodes have into other components.

    Nodes with nothing but links in their lists see only their own group. Here each keeps its nearest nodes of other components, refined
    by rounds over both lists, until these join no components any more. A node asks its own neighbours for theirs, as
    it need not be in any list itself where others are nearer.
    """
    full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).where((F.col("n") >= NEIGHBOURS) & (F.col("least") >= THRESHOLD))
    full = scratch.keep(full.select(F.col("u").alias("id")), "hard")
    groups = scratch.keep(components(links), "vector-groups")
    if full.isEmpty():
        return groups
    hard = scratch.keep(vectors.join(full, "id", "left_semi"), "hard-vectors")
    inside = scratch.keep(_best(graph.join(full.withColumnRenamed("id", "u"), "u", "left_semi"), None, NEIGHBOURS), "inside")
    outside = None
    while True:
        named = scratch.keep(hard.join(groups.withColumnRenamed("node", "id"), "id"), "named")
        fresh = _both(_first_graph(named, seed, floor))
        if outside is not None:
            label = groups.select(F.col("node").alias("u"), F.col("component").alias("cu"))
            still = outside.join(label, "u").join(label.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v").where("cu != cv")
            fresh = fresh.unionByName(still.select("u", "v", "cosine"))
        outside = scratch.keep(_best(fresh, None, NEIGHBOURS), "outside")
        for _ in range(ROUNDS):
            before = outside
            around = _around(outside, NEIGHBOURS).union(_next(inside, outside)).union(_next(outside, inside)).distinct()
            outside = scratch.keep(_best(_both(outside.unionByName(_compared(named, around, floor, NEIGHBOURS))), None, NEIGHBOURS), "outside")
            if _settled(outside, before):
                break
        found = outside.where(F.col("cosine") >= THRESHOLD).select("u", "v")
        if found.isEmpty():
            return groups
        # a component is a star around its least node; new links join stars
        links = scratch.keep(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found), "joined-links")
        groups, seed = scratch.keep(components(links), "vector-groups"), seed + 1


def _lengths(graph: DataFrame, lengths: DataFrame | None, length: int) -> DataFrame:
    """(u, length) of nodes whose list is longer than ``length``: it doubles from its own last length while it is full of links."""
    links = graph.where(F.col("cosine") >= THRESHOLD).groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    if lengths is None:
        return links.where(F.col("links") >= length).select("u", F.lit(min(MOST, 2 * length)).alias("length"))
    own = F.greatest(F.coalesce("length", F.lit(length)), F.lit(length))
    both = links.join(lengths, "u", "full_outer").withColumn("length", F.when(F.col("links") >= own, F.least(F.lit(MOST), 2 * own)).otherwise(own))
    return both.where(F.col("length") > length).select("u", "length")


def _recall(vectors: DataFrame, classes: DataFrame, found: DataFrame) -> float:
    """Links of a bounded sample of classes by brute force against all, and how many of them were found."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(AUDITED).collect()
    shared = spark.sparkContext.broadcast([(r["id"], np.array(r["v"], dtype=np.float64)) for r in sample])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for _, v in shared.value}:
            own = [(i, v) for i, v in shared.value if len(v) == n]
            by_size[n] = np.array([i for i, _ in own]), _unit(np.array([v for _, v in own]))
        for batch in batches:
            size = batch.column(1).to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                if int(n) in by_size:
                    ids, x = by_size[int(n)]
                    row, col = np.nonzero((_unit(_matrix(part.column(2))) @ x.T) >= THRESHOLD)
                    mine, other = ids[col], part.column(0).to_numpy(zero_copy_only=False)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(mine[mine != other]), pa.array(other[mine != other])], names=["id", "other"])

    truth = vectors.select("id", "size", "v").mapInArrow(compare, "id long, other long")
    truth = truth.join(classes.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.sum("n").alias("all"))
    both = truth.join(found, "id", "left").agg(F.sum("all"), F.sum(F.least("all", F.coalesce("linked", F.lit(0))))).head()
    return both[1] / both[0] if both[0] else 1.0


def near_duplicates(rows: DataFrame, report: dict[str, float] | None = None) -> DataFrame:
    """Link rows (vec_id, embedding; other columns do not matter) with a cosine of at least THRESHOLD.

    Returns per row: vec_id, n_links (other rows it links with directly), component_id (the least vec_id that links
    reach, its own included), kept (vec_id = component_id). A vector that is null, empty, zero or holds null or
    non-finite components links with nothing; vectors of different lengths do not link. Equal vectors always link.
    Rows of a repeated vec_id are vectors of their own. An empty table gives an empty table. ``report`` gets the
    audited recall and the number of searches.
    """
    with scratch.steps(rows.sparkSession):
        return _linked(rows, {} if report is None else report)


def _linked(rows: DataFrame, report: dict[str, float]) -> DataFrame:
    floor = 2 * THRESHOLD**2 - 1
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fields = "vec_id long, size int, k1 long, k2 long"
    keys = scratch.keep(rows.mapInArrow(_prepare(False), fields), "vector-keys", stay=True)
    classes = keys.where("size is not null and vec_id is not null").groupBy("size", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")  # numbers that stay, once written
    kind = rows.schema["embedding"].dataType.simpleString()
    valid = rows.mapInArrow(_prepare(True), f"{fields}, v {kind}").withColumnRenamed("vec_id", "rep")
    valid = valid.join(classes.drop("n"), ["size", "k1", "k2", "rep"]).select("id", "size", "v")
    vectors = scratch.keep(valid.dropDuplicates(["id"]), "vectors")
    graph, length = None, NEIGHBOURS
    lengths = None
    for attempt in range(1 + EXTRA):
        fresh = _first_graph(vectors, attempt, floor)
        graph = scratch.keep(_best(_both(fresh if graph is None else graph.unionByName(fresh)), lengths, length), "graph")
        for _ in range(ROUNDS):
            before = graph
            lengths = scratch.keep(_lengths(graph, lengths, length), "lengths")
            graph = scratch.keep(_best(_both(_round(vectors, graph, floor, length)), lengths, length), "graph")
            if _settled(graph, before):
                break
        links = graph.where(F.col("cosine") >= THRESHOLD).select("u", "v")
        groups = _bridged(vectors, graph, links, floor, 1000 * (attempt + 1))
        found = scratch.keep(_counted(vectors, classes, groups), "linked")
        report |= {"recall": _recall(vectors, classes, found), "searches": attempt + 1}
        _log.info("recall %(recall).4f after %(searches)d searches", report)
        if report["recall"] >= RECALL:
            break
        length = min(MOST, 2 * length)
    if report["recall"] < RECALL:
        raise RuntimeError(f"recall {report['recall']:.3f} after {report['searches']} searches")
    known = classes.join(found, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    known = scratch.keep(known.withColumn("component", F.coalesce("component", "id")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("size", "k1", "k2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    known = scratch.keep(known, "vector-components", stay=True)
    out = keys.join(known, ["size", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _counted(vectors: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, linked): rows of other classes that a class of a component links with."""
    n = F.count(F.lit(1))
    tile = F.least(F.lit(TILE), F.greatest(F.lit(LEAST_TILE), 4 * F.sqrt(n)))
    sizes = scratch.keep(groups.groupBy("component").agg(F.ceil(n / tile).cast("int").alias("tiles")), "group-sizes")
    member = scratch.keep(groups.join(sizes, "component"), "members")
    member = member.join(classes.select(F.col("id").alias("node"), "n"), "node").join(vectors.select(F.col("id").alias("node"), "v"), "node")
    member = member.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", F.col("node").alias("id"), "n", "v")
    rows = member.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return rows.mapInArrow(_tiles, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_nn_descent``: all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (
    select vec_id, embedding::double[] e from embeddings
), ok as (
    select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) norm from v
    where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), l as (
    select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id != b.vec_id and a.norm > 0 and b.norm > 0 and len(a.e) = len(b.e)
    and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), r as (
    select vec_id node, vec_id reach from v
    union
    select r.node, l.b from r join l on r.reach = l.a
), n as (select a, count(*) n from l group by a)
select vec_id, coalesce(n, 0)::bigint n_links, min(reach)::bigint component_id, vec_id = min(reach) kept
from v join r on vec_id = node left join n on vec_id = a group by vec_id, n
"""
