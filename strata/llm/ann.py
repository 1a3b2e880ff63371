"""Approximate nearest neighbours by largest inner product (operator 2).

Inner products become distances by one more coordinate: a vector x gets sqrt(M^2 - |x|^2) with M the
largest norm, a query gets 0, and |q - x|^2 = |q|^2 + M^2 - 2 q.x. A fixed 2-stable (Gaussian)
projection maps these to ``DIMS`` dimensions, where the projected squared distance over the true one
is chi-square distributed with ``DIMS`` degrees of freedom. The projections are indexed by a kd-tree:
its upper levels (fitted on a bounded hash sample of ``SAMPLE`` projections) cut the space into cells
of about ``CELL_ROWS`` vectors that Spark groups by; the lower levels are built inside each cell.
A query takes projected neighbours leaf by leaf in ascending projected distance and verifies them on
the original vectors until the chi-square test holds: a vector as near as the current k-th best would
project nearer than the next leaf with probability ``P_STOP``. It does so in its own cell first, then
in every other cell that the test does not yet rule out.

Every vector is indexed. Equal vectors are searched as one that carries its k + 1 smallest ids (no
other can be among k nearest), filtered before the shuffle. Queries of a cell are worked off in blocks.

Cases: a null id, null, zero or empty vectors, null or non-finite components, and vectors whose length
is not the most frequent one take no part. Rows with one id count once, with the smallest vector. With
fewer than k candidates all are returned; ties go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

DIMS, P_STOP, CELL_ROWS, LEAF, SAMPLE, MAX_CELLS, QUERY_BLOCK = 8, 0.95, 16_384, 64, 100_000, 4_096, 8_192
RESULT = "query_id long, vec_id long, score double"


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, dims) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


class Projection:
    def __init__(self, width: int, top: float, seed: int = 7):
        self.top = top  # largest norm
        self.matrix = np.random.default_rng(seed).standard_normal((width + 1, DIMS))

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top ** 2 - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]


class Cells:
    """The upper kd-tree: complete, split at medians of the widest dimension of a sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        inner = 2 ** depth - 1
        self.dim, self.cut = np.zeros(inner, np.int64), np.zeros(inner)
        boxes = [(np.full(DIMS, -np.inf), np.full(DIMS, np.inf))]
        groups = [sample]
        for node in range(inner):
            rows = groups[node]
            j = int((rows.max(axis=0) - rows.min(axis=0)).argmax()) if len(rows) else 0
            c = float(np.median(rows[:, j])) if len(rows) else 0.0
            self.dim[node], self.cut[node] = j, c
            low = rows[:, j] <= c if len(rows) else np.zeros(0, bool)
            groups += [rows[low], rows[~low]]
            lo, hi = boxes[node]
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[j], right_lo[j] = c, c
            boxes += [(lo, left_hi), (right_lo, hi)]
        leaves = boxes[inner:]
        self.lo, self.hi = np.stack([b[0] for b in leaves]), np.stack([b[1] for b in leaves])

    def locate(self, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (y[np.arange(len(y)), self.dim[at]] > self.cut[at])
        return at - (2 ** self.depth - 1)

    def distance(self, y: np.ndarray) -> np.ndarray:
        """Squared distance of one projected query to every cell."""
        return _box_distance(y, self.lo, self.hi)


def _box_distance(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(lo - y, y - hi), 0)
    return (gap * gap).sum(axis=1)


class Tree:
    """The lower kd-tree over one cell: leaf ranges of an order of the points, and leaf boxes."""

    def __init__(self, y: np.ndarray):
        self.order = np.arange(len(y))
        ranges, stack = [], [(0, len(y))]
        while stack:
            a, b = stack.pop()
            if b - a <= LEAF:
                ranges.append((a, b))
                continue
            own = self.order[a:b]
            part = y[own]
            j = int((part.max(axis=0) - part.min(axis=0)).argmax())
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(part[:, j], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.ranges = np.array(ranges, np.int64)
        self.lo = np.stack([y[self.order[a:b]].min(axis=0) for a, b in ranges])
        self.hi = np.stack([y[self.order[a:b]].max(axis=0) for a, b in ranges])


def _best(score: np.ndarray, rows: np.ndarray, ids: list, own: int, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of verified vectors, an id of its own excluded."""
    if len(score) > k + 1:
        least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
        keep = score >= least
        score, rows = score[keep], rows[keep]
    pairs = [(-float(s), i) for s, r in zip(score, rows, strict=True) for i in ids[r] if i != own]
    return sorted(pairs)[:k]


def search_cell(x: np.ndarray, ids: list, q: np.ndarray, query_ids: list[int], bound: np.ndarray, proj: Projection, k: int, p_stop: float):
    """Per query the k best (-score, id) of one cell; ``bound`` is the k-th score known so far."""
    tree = Tree(proj.points(x))
    limit = chi_square_quantile(p_stop, DIMS)
    leaf_of = [tree.order[a:b] for a, b in tree.ranges]
    for vec, y, own, known in zip(q, proj.queries(q), query_ids, bound, strict=True):
        gaps = _box_distance(y, tree.lo, tree.hi)
        leaves = np.argsort(gaps, kind="stable")
        length = float(vec @ vec) + proj.top ** 2
        rows, score, at, step, kth = [], [], 0, 1, known
        while at < len(leaves):
            # chi-square stopping test on the next leaf
            if gaps[leaves[at]] > limit * max(length - 2 * kth, 0.0):
                break
            part = np.concatenate([leaf_of[i] for i in leaves[at:at + step]])
            rows.append(part)
            score.append((x[part] * vec).sum(axis=1))
            at, step = at + step, step * 2
            all_scores = np.concatenate(score)
            if len(all_scores) > k:  # one more than k: the query's own vector may be among them
                kth = max(known, float(np.partition(all_scores, len(all_scores) - k - 1)[len(all_scores) - k - 1]))
        if rows:
            yield own, _best(np.concatenate(score), np.concatenate(rows), ids, own, k)


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _searcher(proj: Projection, k: int, p_stop: float):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if points.num_rows and queries.num_rows:
            bound = queries.column("bound").to_numpy()
            for own, found in search_cell(_vectors(points.column("v")), points.column("ids").to_pylist(), _vectors(queries.column("v")),
                                          queries.column("query_id").to_pylist(), bound, proj, k, p_stop):
                for s, i in found:
                    out_q.append(own)
                    out_v.append(i)
                    out_s.append(-s)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def _in_cells(points: DataFrame, routed: DataFrame, search) -> DataFrame:
    """Searches routed queries (query_id, v, bound, cell, block) in their cells: the points of a cell go
    only to the query blocks that visit it."""
    visits = routed.select(F.col("cell").alias("at"), F.col("block").alias("part")).distinct()
    here = points.join(visits, points["cell"] == F.col("at")).select("at", "part", "v", "ids")
    return here.groupBy("at", "part").cogroup(routed.groupBy("cell", "block")).applyInArrow(search, RESULT)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries_where, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            p_stop: float = P_STOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries_where`` (a condition
    on the id column) selects."""
    spark = vectors.sparkSession
    v, kind = F.col("v"), dict(vectors.dtypes)[vector]
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    rows = staged(usable.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == width[0]["w"])
    # equal vectors: only the k + 1 smallest ids can be answers; the rank filter also runs before the shuffle
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("rn") <= k + 1)
    distinct = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = staged(distinct, "points")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    info = points.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    proj = Projection(width[0]["w"], info["top"])
    depth = max(0, min(math.ceil(math.log2(info["n"] / CELL_ROWS)), int(math.log2(MAX_CELLS)))) if info["n"] > CELL_ROWS else 0
    parts = max(1, math.ceil(info["n"] / (CELL_ROWS * 2 ** depth)))  # beyond MAX_CELLS a cell is searched in parts
    share = int(min(1.0, SAMPLE / info["n"]) * (1 << 20))
    sample = points.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share).select("v").toArrow() if depth else None
    cells = Cells(proj.points(_vectors(sample.column("v"))) if depth else np.zeros((0, DIMS)), depth)
    limit = chi_square_quantile(p_stop, DIMS)

    def place(batches):
        for b in batches:
            x = _vectors(b.column("v"))
            cell = cells.locate(proj.points(x)) if len(x) else np.zeros(0, np.int64)
            part = np.array([i[0] % parts for i in b.column("ids").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell * parts + part), b.column("v"), b.column("ids")], names=["cell", "v", "ids"])

    index = staged(points.mapInArrow(place, f"cell long, v {kind}, ids array<long>"), "ann-index")

    def home(batches):
        for b in batches:
            x = _vectors(b.column("v"))
            cell = cells.locate(proj.queries(x)) if len(x) else np.zeros(0, np.int64)
            out = np.repeat(cell * parts, parts) + np.tile(np.arange(parts), len(cell))
            take = pa.array(np.repeat(np.arange(len(cell)), parts))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), b.column("v").take(take), b.column("bound").take(take),
                                              b.column("block").take(take), pa.array(out)], names=["query_id", "v", "bound", "block", "cell"])

    def others(batches):
        for b in batches:
            x, bound = _vectors(b.column("v")), b.column("bound").to_numpy()
            own = cells.locate(proj.queries(x)) if len(x) else []
            take, out = [], []
            for i, (vec, y, mine, known) in enumerate(zip(x, proj.queries(x), own, bound, strict=True)):
                near = np.flatnonzero(cells.distance(y) <= limit * max(float(vec @ vec) + proj.top ** 2 - 2 * known, 0.0))
                for c in near[near != mine]:
                    take += [i] * parts
                    out += range(c * parts, (c + 1) * parts)
            idx = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(idx), b.column("v").take(idx), b.column("bound").take(idx),
                                              b.column("block").take(idx), pa.array(out, pa.int64())], names=["query_id", "v", "bound", "block", "cell"])

    queries = rows.filter(queries_where(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shape = f"query_id long, v {kind}, bound double, block int, cell long"
    search = _searcher(proj, k, p_stop)
    start = queries.withColumn("bound", F.lit(float("-inf"))).select("query_id", "v", "bound", "block").mapInArrow(home, shape)
    near = staged(_top(_in_cells(index, start, search), k), "ann-home")
    known = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    again = queries.join(known, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))) \
        .select("query_id", "v", "bound", "block").mapInArrow(others, shape)
    found = near.select("query_id", "vec_id", "score").union(_in_cells(index, again, search))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
