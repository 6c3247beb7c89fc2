"""Whitening of embeddings by mixed-precision refinement.

Counts, sums and the covariance of the distinct vectors come from distributed passes; only a matrix
whose size is the number of dimensions reaches the driver. Its eigenvectors are found in single
precision and then corrected in double precision by iterations of matrix products alone, which double
the number of right digits each time (Ogita and Aishima). The corrections divide by differences of
eigenvalues; where these are too close for that, the cluster is solved for itself, shifted by its mean
and scaled to its own spread, again in single precision, and the iterations go on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import kept

SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**53
MOST = np.iinfo(np.int64).max
ROUNDS = 30
EPS = np.finfo(np.float64).eps


def _correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step for approximate eigenvectors ``x``: eigenvalues, step, bound of what is too close, error."""
    skew = np.eye(x.shape[1]) - x.T @ x
    inner = x.T @ (a @ x)
    inner = (inner + inner.T) / 2
    values = np.diag(inner) / (1 - np.diag(skew))
    off = inner - np.diag(values)
    size = np.linalg.norm(a, 2)
    close_up_to = 2 * (np.linalg.norm(off, 2) + size * np.linalg.norm(skew, 2))
    gap, middle = values[None, :] - values[:, None], (values[None, :] + values[:, None]) / 2
    near = np.abs(gap) <= close_up_to
    # Half of the skew makes vectors orthogonal. The rest is a rotation: exactly antisymmetric, also by rounding.
    step = skew / 2 + np.where(near, 0, (inner + middle * skew) / np.where(near, 1, gap))
    np.fill_diagonal(off, 0)
    error = max(np.abs(off).max(initial=0) / size, np.abs(skew).max(initial=0)) if size else 0.0
    return values, step, close_up_to, error


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    best, least, stalled = x, np.inf, 0
    for _ in range(ROUNDS):
        values, step, close, error = _correction(a, x)
        if error < least:
            stalled = 0 if error < least / 2 else stalled + 1
            best, least = x, error
        else:
            stalled += 1
        if least <= 4 * EPS or stalled > 2:
            break
        x = x + x @ step
        order = np.argsort(values)
        apart = np.flatnonzero(np.diff(values[order]) > close)
        for cluster in np.split(order, apart + 1):
            if len(cluster) > 1:
                x[:, cluster] = x[:, cluster] @ _sub_solved(a, x[:, cluster])
    x = best / np.sqrt((best**2).sum(0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _sub_solved(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rotation of a cluster's vectors that turns them into eigenvectors, to single precision of its spread."""
    mean = np.einsum("ij,ij->", x, a @ x) / x.shape[1]
    inner = x.T @ (a @ x - mean * x)
    inner = (inner + inner.T) / 2
    spread = np.abs(inner).max()
    if np.abs(inner - np.diag(np.diag(inner))).max() <= 4 * EPS:
        return np.eye(x.shape[1])
    turn = np.linalg.eigh((inner / spread).astype(np.float32))[1].astype(np.float64)
    # Orthogonal to double precision, so that a turn costs no accuracy.
    for _ in range(2):
        turn = turn + turn @ (np.eye(len(turn)) - turn.T @ turn) / 2
    return turn


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key, and ``x`` array<bigint>: floor(64 c) + 1000000 of every component c. Null and non-finite ones go."""
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(
        "v", lambda c: F.least(F.greatest(F.floor(c * SCALE).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST)).cast("bigint") + OFFSET
    )
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & finite).select(F.col(key), whole.alias("x"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dimensions)


def _summed(rows: DataFrame, dimensions: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums over all vectors of what ``part`` makes of each batch (a matrix or a row of them): (i, j, sum).

    Every task adds up its own batches; only one number per place leaves it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(_matrix(batch.column(0), dimensions))
                total = made if total is None else total + made
        if total is not None:
            i, j = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(j), pa.array(total.ravel().tolist(), pa.int64() if kind == "bigint" else pa.float64())],
                names=["i", "j", "s"],
            )

    made = rows.select("x").mapInArrow(work, f"i bigint, j bigint, s {kind}")
    return made.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)") if kind == "bigint" else "s").alias("s")).collect()


def _filled(sums: list, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in sums:
        out[r["i"], r["j"]] = r["s"]
    return out


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and the lower 32 bits by dimension, which cannot overflow in a task, and the number of rows."""
    rows = np.full((1, x.shape[1]), len(x), np.int64)
    return np.concatenate([(x >> 32).sum(0)[None], (x & 0xFFFFFFFF).sum(0)[None], rows])


class Fit:
    """Count, sums and components of the distinct vectors ``x`` of one length."""

    def __init__(self, rows: DataFrame, dimensions: int, components: int):
        sums = {(r["i"], r["j"]): int(r["s"]) for r in _summed(rows, dimensions, _halves, "bigint")}
        self.n = n = sums[2, 0]
        self.sums = [(sums[0, j] << 32) + sums[1, j] for j in range(dimensions)]
        # x less a whole number near the mean is exact in doubles; the rest of the mean is below 1.
        self.near = np.array([s // n for s in self.sums], np.int64)
        self.over = [s % n for s in self.sums]
        self.rest = np.array([o / n for o in self.over])
        near, rest = self.near, self.rest

        def products(x: np.ndarray) -> np.ndarray:
            d = (x - near).astype(np.float64) - rest
            return d.T @ d

        covariance = _filled(_summed(rows, dimensions, products, "double"), (dimensions, dimensions)) / n
        covariance = (covariance + covariance.T) / 2
        values, vectors = eigen(covariance)
        k = min(components, int((values > dimensions * EPS * values[:1].sum()).sum()))
        self.trace = float(np.trace(covariance))
        self.explained = values[:k] / self.trace if k else np.zeros(0)
        self.turn = turn = vectors[:, :k] / np.sqrt(values[:k])

        def squares(x: np.ndarray) -> np.ndarray:
            w = ((x - near).astype(np.float64) - rest) @ turn
            return w.T @ w

        # The whitened vectors have mean 0, as the vectors less their mean have.
        white = _filled(_summed(rows, dimensions, squares, "double"), (k, k)) / n if k else np.zeros((0, 0))
        self.identity_error = float(np.abs(white - np.eye(k)).max(initial=0))


def deviations(x: np.ndarray, near: np.ndarray, over: list[int], n: int) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; the largest long where it is more than one holds."""
    y = x - near
    if (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1]) < MOST:
        return ((n * y - np.array(over, np.int64)) ** 2).sum(1)
    exact = [sum((n * int(v) - o) ** 2 for v, o in zip(row, over, strict=True)) for row in y]
    return np.array([min(e, MOST) for e in exact], np.int64)


def whitened(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` per row and component.

    Rows whose vector is null or holds null or non-finite entries go; all others stay, repeated keys and null
    keys, too. The fit is made on each distinct vector once. Vectors of another length than most distinct ones
    (of equally many, the longest) lie in another space and go. Entries beyond 2^53 count as 2^53, deviations
    beyond a long as the largest long. Components without variance, or with less than the rounding of the largest,
    are left out: fewer distinct vectors than components give fewer, one gives none. An empty table gives an
    empty one.
    """
    rows = usable(vectors, key, vector)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, "
    schema += "whitened double, explained double, identity_error double"
    distinct = kept(rows.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None or not most["d"]:
        return rows.sparkSession.createDataFrame([], schema)
    same = F.size("x") == most["d"]
    fit = Fit(distinct.filter(same), most["d"], components)
    near, over, n, rest, turn = fit.near, fit.over, fit.n, fit.rest, fit.turn
    explained, error, dimensions = fit.explained, fit.identity_error, most["d"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1), dimensions)
            size = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n, np.int64)),
                    pa.array(np.repeat(deviations(x, near, over, n), k)),
                    pa.array((((x - near).astype(np.float64) - rest) @ turn).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(same).mapInArrow(work, schema)
