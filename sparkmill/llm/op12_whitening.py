"""Embedding whitening by LOBPCG: the leading principal components of all distinct vectors, found through block products.

Method:

1.  Entries become whole numbers; equal vectors are one row of the fit list, which Spark makes distinct and writes.
    Sums by dimension are exact, so centred entries are right to the last bit.
2.  A block product is one pass over the fit list: each task multiplies its centred rows with a small block and returns
    one matrix of the block's size; these are added in two levels, the last on the driver.
3.  Rayleigh-Ritz on the iterate, its residual and the previous direction gives the next iterate, until the residuals
    of all wanted components, computed from a fresh product, are certified.
4.  A last pass over all rows projects and scales them. What is broadcast, collected or held by a task is as large as
    dimensions times components.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch

#: Components returned, and how many more the block has, which only speed it up.
COMPONENTS, GUARD = 16, 4
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on would leave the range of the exact sums.
LARGEST = 2.0**55
#: Residuals, as shares of the first eigenvalue, that end the search; that pass where a round brings no more; rounds at most.
RESIDUAL, CERTIFIED, ROUNDS = 1e-14, 1e-11, 500
#: Eigenvalues below this share of the first are zero to double precision.
ZERO = 1e-12
#: Rows that a task multiplies at once; groups in which the tasks' matrices are added.
STRIPE, ADDED = 4096, 64

_log = logging.getLogger(__name__)


@dataclass
class Centre:
    """The exact mean S / n of the fit list as whole parts and rests: S = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
        y = x - self.whole
        if len(y) and int(np.abs(y).max()) * self.n >= 1 << 62:
            y = y.astype(object)
        return y * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row; null where that is no long."""
        y = self.scaled(x)
        if y.dtype != object and (not len(y) or (y.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62):
            return (y * y).sum(axis=1).tolist()
        sums = [sum(int(v) * int(v) for v in row) for row in y]
        return [s if s < 1 << 63 else None for s in sums]


@dataclass
class Whitening:
    """``components``: unit eigenvectors as columns, with their ``eigenvalues``, of the covariance with this ``trace``."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float
    rounds: int


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("embedding") > 0).where(F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))))


def _whole(rows: DataFrame, size: int) -> DataFrame:
    """(vec_id, x) of the usable vectors of this size, x as whole numbers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(SCALE * _matrix(batch.column(1), size).astype(np.float64)).astype(np.int64) + SHIFT
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["vec_id", "x"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    own = _usable(rows.select("vec_id", "embedding")).where(F.size("embedding") == size)
    return own.mapInArrow(convert, f"vec_id {kind}, x array<long>")


def _centre(fit: DataFrame, size: int) -> Centre:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(fit.mapInArrow(sums, "at int, n long, high long, low long").groupBy("at").agg(*total).collect())  # a row a dimension
    n = int(rows[0]["n"]) if rows else 0
    parts = [divmod((int(r["high"]) << 32) + int(r["low"]), n) for r in rows] if n else []
    return Centre(n, np.array([w for w, _ in parts], dtype=np.int64), np.array([r for _, r in parts], dtype=np.int64))


def _summed(fit: DataFrame, size: int, centre: Centre, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of ``part``, which turns centred rows into one array of a fixed size."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), STRIPE):
                some = part(centre.centred(x[at : at + STRIPE]))
                total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = np.frombuffer(raw, "<f8") + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = fit.mapInArrow(own, "part binary").repartition(F.spark_partition_id() % ADDED)
    rows = parts.mapInArrow(added, "part binary").collect()  # at most as many as there are shuffle partitions
    return sum(np.frombuffer(r["part"], "<f8") for r in rows)


def _directions(block: np.ndarray, x: np.ndarray) -> np.ndarray:
    """An orthonormal base of what a block has outside the span of x."""
    for _ in range(2):
        block = block - x @ (x.T @ block)
        norm = np.linalg.norm(block, axis=0)
        block = block[:, norm > 0] / norm[norm > 0]
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10 * s[0]]
    u, _ = np.linalg.qr(u - x @ (x.T @ u))
    return u[:, : x.shape[0] - x.shape[1]]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading eigenvectors (columns), eigenvalues, certified residual (a share of the first eigenvalue) and rounds.

    ``product`` multiplies the matrix with a block. An error if the residuals stay above ``CERTIFIED``.
    """
    block = min(size, wanted + GUARD)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, block)))
    wanted, p, best, still = min(wanted, size), x[:, :0], np.inf, 0
    vx, fresh = product(x), True
    for rounds in range(ROUNDS):
        value, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        turn, value = turn[:, ::-1], value[::-1]
        x, vx = x @ turn, vx @ turn
        residual = vx - x * value
        worst = np.linalg.norm(residual[:, :wanted], axis=0).max() / max(value[0], np.finfo(float).tiny)
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        w = _directions(np.concatenate([residual, p], axis=1), x)
        done = worst <= RESIDUAL or not w.size or (still >= 3 and worst <= CERTIFIED)
        if done and fresh:
            if worst > CERTIFIED:
                break
            return x[:, :wanted], value[:wanted], float(worst), rounds
        if done or rounds % 16 == 15:  # sums of products drift a little; the certificate needs one of its own
            x, _ = np.linalg.qr(x)
            vx, fresh = product(x), True
            continue
        s, vs = np.concatenate([x, w], axis=1), np.concatenate([vx, product(w)], axis=1)
        _, turn = np.linalg.eigh((s.T @ vs + vs.T @ s) / 2)
        turn = turn[:, ::-1][:, :block]
        p = w @ turn[block:]
        x, vx, fresh = s @ turn, vs @ turn, False
    raise RuntimeError(f"residuals stay at {best:.1e} of the first eigenvalue")


def fitted(rows: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (vec_id, embedding); None where no vector differs from another. See :func:`whitened`."""
    sizes = _usable(rows.select("embedding")).groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").head()
    if most is None:
        return None
    size = most["size"]
    with scratch.steps(rows.sparkSession):
        fit = scratch.keep(_whole(rows, size).select("x").distinct(), "fit-list")
        centre = _centre(fit, size)
        trace = float(_summed(fit, size, centre, lambda c: np.array([(c * c).sum()]))[0]) / centre.n
        if not trace:
            return None

        def product(block: np.ndarray) -> np.ndarray:
            return _summed(fit, size, centre, lambda c: (c.T @ (c @ block)).ravel()).reshape(block.shape) / centre.n

        x, value, residual, rounds = lobpcg(product, size, wanted)
        x, value = x[:, value > ZERO * value[0]], value[value > ZERO * value[0]]
        scaled = x / np.sqrt(value)
        mean = _summed(fit, size, centre, lambda c: (c @ scaled).sum(axis=0)) / centre.n

        def spread(c: np.ndarray) -> np.ndarray:
            w = c @ scaled - mean
            return (w.T @ w).ravel()

        covariance = _summed(fit, size, centre, spread).reshape(len(value), -1) / centre.n
    error = float(np.abs(covariance - np.eye(len(value))).max())
    _log.info("%d components of %d vectors, residual %.1e after %d rounds, covariance off by %.1e", len(value), centre.n, residual, rounds, error)
    return Whitening(centre, x, value, trace, error, residual, rounds)


def whitened(rows: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Whiten rows (vec_id, embedding; other columns do not matter) by the leading principal components of distinct vectors.

    Returns a row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors),
    deviation (exact squared distance from the mean, times n^2; null where that is no long), whitened, explained (share of
    the trace), identity_error (largest absolute entry of the whitened covariance minus the identity).

    A vector that is null, empty, or holds null, non-finite or larger entries than 2^55 has no rows, nor has one that is
    not as long as most vectors (of equally many the shorter). Rows of a repeated or null vec_id each have their own. There
    are no more components than dimensions, nor such whose eigenvalue is zero to double precision; so vectors that are all
    equal, and an empty table, give no rows. Components of equal eigenvalues are any base of their space.
    """
    model = fitted(rows, wanted)
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    centre, scaled, share, error = model.centre, model.components / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace, model.identity_error
    size, k = scaled.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIPE):
                part = batch.slice(at, STRIPE)
                x = _matrix(part.column(1), size)
                again = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [
                    part.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, centre.n)),
                    pa.array(centre.deviation(x), pa.int64()).take(again),
                    pa.array((centre.centred(x) @ scaled).ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _whole(rows, size).mapInArrow(project, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op12_whitening``: all embeddings, 16 components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
