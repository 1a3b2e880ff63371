"""Many k-means runs in one pass over the points (K4, K9).

A run is a choice of k, of a start and, for a bootstrap, of a resample. All runs advance together: an iteration
is one job in which every task assigns its points to the centres of all runs that still move and sends partial
sums per (run, centre); Spark adds them up, and the driver holds centres only (runs x k x dimensions numbers).
A resample is not drawn: each point has a Poisson(1) weight from a keyed hash of its id, the same wherever and whenever
it is read. Starts are k-means++ on a hash sample of at most ``SAMPLE`` points; everything else uses all points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, materialize, ship_package

SAMPLE = 2_000
#: Distances that a task holds at a time.
CELLS = 1 << 20
#: Distances of one pass that make a task of their own worthwhile, and points that a task reads at most.
TASK_CELLS, TASK_POINTS = 1 << 23, 100_000
#: Sums of at most so many tasks are added by the driver, without a shuffle in every pass.
FEW_PARTS = 16
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(15)])


@dataclass
class Run:
    k: int
    start: int
    resample: int | None = None
    centres: np.ndarray | None = None
    cost: float = math.inf
    moving: bool = True


def weights(keys: np.ndarray, resample: int | None) -> np.ndarray:
    """Times that each point is in a resample (1 without one), from the 64-bit hash of its id."""
    if resample is None:
        return np.ones(len(keys))
    x = keys.view(np.uint64) + np.uint64((resample + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53, side="right").astype(float)


def keyed(points: DataFrame, id_col: str, features: str = "features") -> DataFrame:
    """(key, x): hash of the id and the vector as an array, stored once for all passes, in at least one part per core:
    the work of a pass is points x runs, so a file or two of points would leave it to as many tasks."""
    ship_package(points.sparkSession)
    x = points.select(F.xxhash64(id_col).alias("key"), vector_to_array(features).alias("x"))
    return dealt(x, points.sparkSession.sparkContext.defaultParallelism)


def packed(data: DataFrame, cells: int) -> DataFrame:
    """The points of ``keyed`` for the many passes of a fit: (keys, points), a batch of rows as two byte strings. A pass then
    reads a few long values instead of a row a point. ``cells``: distances a point has in a pass; parts with too few
    for a task are put together, but not below one part a core."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("key").to_numpy().tobytes()], pa.binary()),
                                                  pa.array([batch.column("x").flatten().to_numpy().tobytes()], pa.binary())], names=["keys", "points"])

    parts = max(data.sparkSession.sparkContext.defaultParallelism, math.ceil(data.count() * max(cells / TASK_CELLS, 1 / TASK_POINTS)))
    few = data.coalesce(parts) if data.rdd.getNumPartitions() > parts else data
    return materialize(few.mapInArrow(run, "keys binary, points binary"))


def _points(batch: pa.RecordBatch):
    """(keys, points) of the rows of ``keyed``, or of each row of ``packed``."""
    if "x" in batch.schema.names:
        yield batch.column("key").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        return
    for k, x in zip(batch.column("keys"), batch.column("points"), strict=True):
        keys = np.frombuffer(k.as_buffer(), np.int64)
        yield keys, np.frombuffer(x.as_buffer(), float).reshape(len(keys), -1)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0.0)


def partial_sums(data: DataFrame, part: Callable[[np.ndarray, np.ndarray], list[tuple[int, int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all points of the vectors that ``part`` (keys, points) gives per (run, centre)."""
    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for own, x in _points(batch) if batch.num_rows else ():
                for i, j, v in part(own, x):
                    held[i, j] = held[i, j] + v if (i, j) in held else v
        keys = list(held)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()),
                                              pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(held[k]) for k in keys]]), pa.int32()),
                                                                       pa.array(np.concatenate([held[k] for k in keys])))], names=["run", "centre", "v"])

    parts = data.mapInArrow(run, "run int, centre int, v array<double>")
    if data.rdd.getNumPartitions() <= FEW_PARTS:
        t, out = parts.toArrow(), {}
        for i, j, v in zip(t.column("run").to_pylist(), t.column("centre").to_pylist(), t.column("v"), strict=True):
            v = v.values.to_numpy()
            out[i, j] = out[i, j] + v if (i, j) in out else v
        return out
    rows = parts.select("run", "centre", array_to_vector("v").alias("v")) \
        .groupBy("run", "centre").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    return {(r["run"], r["centre"]): r["v"].toArray() for r in rows}


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    x, w = x[w > 0], w[w > 0]
    centres = [x[rng.choice(len(x), p=w / w.sum())]]
    near = squared_distances(x, np.array(centres))[:, 0]
    while len(centres) < k:
        p = near * w
        centres.append(x[rng.choice(len(x), p=p / p.sum() if p.sum() > 0 else w / w.sum())])
        near = np.minimum(near, squared_distances(x, np.array(centres[-1:]))[:, 0])
    return np.array(centres)


def _assigned(runs: Sequence[tuple[int, int | None, np.ndarray]]):
    """The runs of equal k, and per such family one vector: costs, weights of the centres and weighted sums of their
    points. A family is worked off together, a few points at a time: one product for all distances, one for all sums."""
    families = []
    for k in sorted({len(c) for *_, c in runs}):
        own = [r for r in runs if len(r[2]) == k]
        centres = np.stack([c for *_, c in own], axis=1)                      # k x runs x dimensions
        drawn = sorted({b for _, b, _ in own}, key=lambda b: (b is not None, b))
        families.append((k, [i for i, *_ in own], centres.reshape(-1, centres.shape[2]), (centres * centres).sum(axis=2)[..., None],
                         drawn, np.array([drawn.index(b) for _, b, _ in own])))

    def part(keys, x):
        out = []
        for family, (k, ids, flat, squares, drawn, of) in enumerate(families):
            n, dims = len(ids), x.shape[1]
            cost, weight, sums = np.zeros(n), np.zeros((k, n)), np.zeros((k * n, dims))
            step = max(1, CELLS // (k * n))
            for lo in range(0, len(x), step):
                own = x[lo:lo + step]
                w = np.stack([weights(keys[lo:lo + step], b) for b in drawn])[of]
                d = np.maximum((own * own).sum(axis=1) - 2 * (flat @ own.T).reshape(k, n, -1) + squares, 0.0)
                near, least = np.zeros(w.shape, np.int8 if k < 128 else np.int64), d[0].copy()
                for j in range(1, k):
                    np.copyto(near, j, where=d[j] < least)
                    np.minimum(least, d[j], out=least)
                cost += (w * least).sum(axis=1)
                for j in range(k):
                    np.multiply(w, near == j, out=d[j])
                weight += d.sum(axis=2)
                sums += d.reshape(k * n, -1) @ own
            out.append((family, 0, np.concatenate([cost, weight.ravel(), sums.ravel()])))
        return out

    return [(k, ids) for k, ids, *_ in families], part


def _unpacked(families: Sequence[tuple[int, list[int]]], sums: dict[tuple[int, int], np.ndarray]):
    """(run, cost, weight per centre, weighted sum per centre) from the vectors of ``_assigned``."""
    for family, (k, ids) in enumerate(families):
        v, n = sums[family, 0], len(ids)
        weight, total = v[n:n + k * n].reshape(k, n), v[n + k * n:].reshape(k, n, -1)
        for r, i in enumerate(ids):
            yield i, float(v[r]), weight[:, r], total[:, r]


def fit_runs(data: DataFrame, runs: list[Run], max_iter: int = 100, tol: float = 1e-4) -> list[Run]:
    """All runs to the end: centres that move no further than ``tol``, or ``max_iter``; costs belong to the last centres.
    An empty cluster keeps its centre."""
    rows = data.orderBy("key").limit(SAMPLE).collect()
    if not rows:
        return runs
    keys, x = np.array([r["key"] for r in rows], np.int64), np.array([r["x"] for r in rows], float)
    for run in runs:
        w = weights(keys, run.resample)
        run.centres = _plus_plus(x, w if w.any() else np.ones(len(x)), run.k, np.random.default_rng([run.start, run.k, (run.resample or -1) + 1]))
    blocks = packed(data, sum(r.k for r in runs))
    for step in range(max_iter + 1):
        live = [(i, r.resample, r.centres) for i, r in enumerate(runs) if r.moving]
        if not live:
            break
        families, part = _assigned(live)
        for i, cost, n, total in _unpacked(families, partial_sums(blocks, part)):
            centres = runs[i].centres
            new = np.where(n[:, None] > 0, total / np.where(n > 0, n, 1.0)[:, None], centres)
            # the cost is that of the centres before the move: they are kept once the move is small
            runs[i].cost = cost
            if step == max_iter or ((new - centres) ** 2).sum(axis=1).max() <= tol ** 2:
                runs[i].moving = False
            else:
                runs[i].centres = new
    return runs


def best_of(runs: Sequence[Run]) -> Run:
    return min(runs, key=lambda r: (r.cost, r.start))


def quality(data: DataFrame, models: list[Run]) -> list[tuple[float | None, float | None, float | None]]:
    """(silhouette, Davies-Bouldin, Calinski-Harabasz) of each model on all points, in two passes for all models. The
    silhouette uses squared distances, whose cluster means follow from sums (as in ``segments.silhouette``)."""
    def moments(keys, x):
        out = []
        for i, m in enumerate(models):
            near = squared_distances(x, m.centres).argmin(axis=1)
            for j in range(m.k):
                own = x[near == j]
                if len(own):
                    out.append((i, j, np.concatenate([[len(own), (own * own).sum()], own.sum(axis=0)])))
        return out

    found = partial_sums(data, moments)
    tables = []
    for i, m in enumerate(models):
        used = [j for j in range(m.k) if (i, j) in found]
        tables.append((used, np.array([found[i, j][0] for j in used]), np.array([found[i, j][1] for j in used]), np.array([found[i, j][2:] for j in used])))

    def spread(keys, x):
        out, q = [], (x * x).sum(axis=1)
        for i, (m, (used, n, sq, s)) in enumerate(zip(models, tables, strict=True)):
            near = squared_distances(x, m.centres)[:, used].argmin(axis=1)
            total = np.maximum(n * q[:, None] + sq - 2 * x @ s.T, 0.0)
            at = np.arange(len(x))
            own = total[at, near]
            mean = total / n
            mean[at, near] = np.inf
            b = mean.min(axis=1)
            a = own / np.maximum(n[near] - 1, 1)
            top = np.maximum(a, b)
            width = np.where((n[near] <= 1) | ~np.isfinite(b) | (top == 0), 0.0, (b - a) / np.where(top > 0, top, 1.0))
            gap = np.sqrt(np.maximum(((x - (s / n[:, None])[near]) ** 2).sum(axis=1), 0.0))
            for j in range(len(used)):
                mine = near == j
                if mine.any():
                    out.append((i, j, np.array([mine.sum(), width[mine].sum(), gap[mine].sum(), (gap[mine] ** 2).sum()])))
        return out

    sums, out = partial_sums(data, spread), []
    for i, (used, n, _, s) in enumerate(tables):
        k, total = len(used), n.sum()
        rows = np.array([sums[i, j] for j in range(k)])
        cen = s / n[:, None]
        within, between = rows[:, 3].sum(), (n * ((cen - s.sum(axis=0) / total) ** 2).sum(axis=1)).sum()
        scatter, apart = rows[:, 2] / n, np.sqrt(squared_distances(cen, cen))
        np.fill_diagonal(apart, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            db = float(np.nanmax((scatter[:, None] + scatter) / apart, axis=1).mean()) if k > 1 else None
        ch = float(between / (k - 1) / (within / (total - k))) if k > 1 and total > k and within > 0 else None
        out.append((float(rows[:, 1].sum() / total), db, ch))
    return out


def adjusted_rand(table: np.ndarray) -> float:
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    n, same = table.sum(), pairs(table)
    a, b = pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    expected, most = a * b / (n * (n - 1) / 2) if n > 1 else 0.0, (a + b) / 2
    return 1.0 if most == expected else (same - expected) / (most - expected)


def agreement(data: DataFrame, pairs: list[tuple[Run, Run]]) -> list[float]:
    """Adjusted Rand index of each (base, resampled) pair on the resample, from contingency tables of one pass."""
    def tables(keys, x):
        out = []
        for i, (a, b) in enumerate(pairs):
            w = weights(keys, b.resample)
            code = squared_distances(x, a.centres).argmin(axis=1) * b.k + squared_distances(x, b.centres).argmin(axis=1)
            out.append((i, 0, np.bincount(code, weights=w, minlength=a.k * b.k)))
        return out

    found = partial_sums(data, tables)
    return [adjusted_rand(found[i, 0].reshape(a.k, b.k)) for i, (a, b) in enumerate(pairs)]


def label(points: DataFrame, id_col: str, model: Run, features: str = "features") -> DataFrame:
    """(id, cluster): the nearest centre of each point."""
    x = vector_to_array(features)
    apart = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
             for c in model.centres]
    return points.select(id_col, F.array(*apart).alias("_d")).select(id_col, (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("cluster"))
