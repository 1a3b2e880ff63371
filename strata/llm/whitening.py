"""Embedding whitening (operator 13): principal directions of all vectors without forming their covariance.

Entries become whole numbers x = floor(64 c) + 1000000, so the number of vectors n and the sums S per
dimension are exact. Each task reduces its centred rows (n x - S) / n, block by block, to a triangle R by QR
(R stacked on the next block, factored again); triangles of tasks are stacked and factored in a tree, so that
one d x d triangle is left with R^T R = n V. Of that triangle (its size is the number of dimensions, not of rows)
:mod:`.bidiagonal` finds singular values by dqds and the whitening directions by twisted factorisations. Rows are
then projected where they lie. Their covariance is checked by a further pass of partial sums, merged in the same
tree with their means (Chan's update).

Cases: vectors that are null, empty, or hold null, non-finite or huge (``LARGEST``) entries
are dropped. Vectors must have one length;
of several lengths the most frequent one counts (the smaller of equally frequent ones), the others are dropped.
Components without variance (singular value at rounding of the largest) are not returned, so there can be fewer
than ``components``. deviation is null where it does not fit a long. Null and repeated ids are kept as rows. An
empty table, and one whose vectors are all equal, give an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bidiagonal import EPS, singular

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BLOCK_ROWS, FAN_IN = 4096, 32
#: Entries from here on have no whole number in a long; their vectors are dropped like those with infinite ones.
LARGEST = 2 ** 56
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    v = F.col("v")
    fits = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(LARGEST)), F.lit(False))
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")) \
        .filter((F.size(v) > 0) & F.forall(v, fits))
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return usable.filter(F.size(v) == (lengths[0]["d"] if lengths else 0)) \
        .select("vec_id", F.transform(v, lambda c: F.when(fits(c), F.floor(F.lit(float(SCALE)) * c) + OFFSET)).alias("x"))


def totals(x: DataFrame) -> tuple[int, list[int]]:
    """n and the sums per dimension, exact: a row per dimension leaves each task."""
    rows = x.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")) \
        .orderBy("k").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _blocks(batch: pa.RecordBatch, d: int, size: int = BLOCK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, part.column("x").flatten().to_numpy().reshape(-1, d)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs while these can hold it, else in Python's whole numbers."""
    top = max(int(np.abs(x).max()), 1) * n + max(abs(s) for s in sums)
    if top < 2 ** 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _numerators(x, n, sums).astype(float) / n


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    top = _numerators(x, n, sums)
    if float(np.abs(top).max()) ** 2 * top.shape[1] < 2.0 ** 62:
        return (top * top).sum(axis=1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in top]
    return [e if e < 2 ** 63 else None for e in exact]


def _one(part: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["part", "m"])


def _fold(first: Callable[[pa.RecordBatch], Iterator[np.ndarray]], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """A task function that merges the matrices ``first`` makes of its batches to one row."""
    def run(batches):
        held = None
        for batch in batches:
            for m in first(batch):
                held = m if held is None else merge(held, m)
        if held is not None:
            yield _one(TaskContext.get().partitionId(), held)

    return run


def reduce_tree(rows: DataFrame, first, merge, width: int) -> np.ndarray | None:
    """One matrix of ``width`` columns from all rows: every task folds its own, then the tasks' matrices are merged
    level by level, about ``FAN_IN`` in a task. The driver takes the last one (null without rows)."""
    def again(batch):
        return (np.array(m).reshape(-1, width) for m in batch.column("m").to_pylist())

    parts = materialize(rows.mapInArrow(_fold(first, merge), "part long, m array<double>"))
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(left))).repartition(left, "group").sortWithinPartitions("group", "part") \
            .drop("group").mapInArrow(_fold(again, merge), "part long, m array<double>")
    found = parts.select("m").collect()
    return np.array(found[0]["m"]).reshape(-1, width) if found else None


def triangle(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R with R^T R = the centred rows' cross products, by blockwise QR."""
    d = len(sums)
    return reduce_tree(x, lambda batch: (np.linalg.qr(centred(block, n, sums), mode="r") for _, block in _blocks(batch, d)),
                       lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r"), d)


@dataclass(frozen=True)
class Whitening:
    """``directions`` holds a unit vector per column, ``variances`` its eigenvalue, ``trace`` that of the covariance."""
    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.directions / np.sqrt(self.variances))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors (none without vectors)."""
    n, sums = totals(x)
    if not n:
        return None
    r = triangle(x, n, sums)
    if len(r) < len(sums):
        r = np.vstack([r, np.zeros((len(sums) - len(r), len(sums)))])
    squares, directions = singular(r, components)
    real = squares > (EPS * len(sums)) ** 2 * max(squares.max(initial=0.0), 0.0)
    return Whitening(n, sums, squares[real] / n, directions[:, real], float((r * r).sum() / n))


def covariance(x: DataFrame, model: Whitening) -> np.ndarray:
    """Covariance of the whitened vectors, from partial (count, mean, centred products) of all tasks."""
    d, k = len(model.sums), len(model.variances)

    def moments(batch):
        for _, block in _blocks(batch, d):
            w = model.apply(block)
            mean = w.mean(axis=0)
            yield np.vstack([np.full(k, float(len(w))), mean, (w - mean).T @ (w - mean)])

    def merge(a, b):
        na, nb = a[0, 0], b[0, 0]
        gap = b[1] - a[1]
        return np.vstack([a[0] + b[0], a[1] + gap * (nb / (na + nb)), a[2:] + b[2:] + np.outer(gap, gap) * (na * nb / (na + nb))])

    found = reduce_tree(x, moments, merge, k)
    return found[2:] / model.n


def project(x: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component."""
    d, k = len(model.sums), len(model.variances)
    explained = model.variances / model.trace

    def run(batches):
        for batch in batches:
            for part, block in _blocks(batch, d, 1024):
                rows = np.repeat(np.arange(len(block)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                    pa.array(np.full(len(rows), model.n, np.int64)), pa.array(deviation(block, model.n, model.sums), pa.int64()).take(pa.array(rows)),
                    pa.array(model.apply(block).ravel()), pa.array(np.tile(explained, len(block)))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return x.mapInArrow(run, RESULT)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """RESULT of every vector and component, with identity_error: the largest absolute entry of the whitened
    vectors' covariance less the identity."""
    x = whole(vectors, vec_id, embedding)
    model = fit(x, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], RESULT + ", identity_error double")
    error = float(np.abs(covariance(x, model) - np.eye(len(model.variances))).max())
    return project(x, model).withColumn("identity_error", F.lit(error))
