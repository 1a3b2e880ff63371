"""Leaf-wise histogram boosting for a binary label; many runs advance in one pass.

Rows are binned once (numbers by exact quantiles, categories by level, bin 0 = missing or unknown) and stored narrow. A pass is
one Spark job: every task puts its rows into the leaves of the growing trees and sends, per (run, leaf, feature, bin), sums of
gradients, second derivatives and rows; Spark adds them up. The driver sees runs x leaves x features x bins numbers at most,
whatever the number of rows. A run is a held-out fold (or none) with a set of features, so k folds, an ablation and a full fit
read the table together. Only the smaller child of a split is counted, its sibling is the difference.

Leaf-wise order is kept exactly: a pass counts the children of every leaf that the best-first order reaches with what is known
so far, which contains all leaves that the full order splits. A tree takes as many passes as it is deep.

Gradients are added as fixed-point integers, so sums, splits and scores are the same under any partitioning and after a lost
executor. Row sampling is a keyed hash of the row's id and the tree's number.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .audit import to_long
from .order import exact_quantiles, present

#: One unit of a gradient sum. Sums stay below 2^63 for up to 2^32 rows.
UNIT = 2.0 ** -30
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Settings:
    rounds: int = 700
    step: float = 0.05
    leaves: int = 48
    max_depth: int | None = None
    min_child: int = 60
    subsample: float = 0.85
    feature_share: float = 0.8
    alpha: float = 0.5
    lam: float = 2.0
    cat_smooth: float = 10.0
    cat_lam: float = 10.0
    max_bins: int = 64
    seed: int = 42
    refresh: int = 5


@dataclass
class Bins:
    """Edges of the numbers and levels of the categories, both at most ``size`` - 2 long; features in this order."""
    numbers: dict[str, np.ndarray]
    levels: dict[str, list[str]]
    size: int

    @property
    def features(self) -> list[str]:
        return [*self.levels, *self.numbers]

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.features)), np.uint8)
        for i, (c, known) in enumerate(self.levels.items()):
            if known:
                out[:, i] = pc.fill_null(pc.index_in(batch.column(c), value_set=pa.array(known, pa.string())), -1).to_numpy(zero_copy_only=False) + 1
        for i, (c, edges) in enumerate(self.numbers.items(), len(self.levels)):
            x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
            out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, side="left"))
        return out


def feature_columns(cats: Sequence[str], nums: Sequence[str]) -> list:
    return [*[F.col(c).cast("string").alias(c) for c in cats], *[F.col(c).cast("double").alias(c) for c in nums]]


def fit_bins(train: DataFrame, cats: Sequence[str], nums: Sequence[str], size: int = 64) -> Bins:
    """Exact quantile edges per number and the most frequent levels per category (ties: smaller level). NULL, NaN, levels
    beyond the first ``size`` - 2 and unseen levels share bin 0."""
    if not 4 <= size <= 256:
        raise ValueError("bins fit one byte: 4 to 256")
    edges = {c: np.array([]) for c in nums}
    if nums:
        long = to_long(train.select([F.when(present(c), F.col(c).cast("double")).alias(c) for c in nums]), nums)
        q = exact_quantiles(long, "value", [i / (size - 1) for i in range(1, size - 1)], by=["variable"])
        for row in q.groupBy("variable").agg(F.array_sort(F.collect_set("value")).alias("edges")).collect():
            edges[row["variable"]] = np.array(row["edges"], np.float64)
    levels = {}
    for c in cats:
        top = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n")) \
            .orderBy(F.desc("n"), "level").limit(size - 2)
        levels[c] = sorted(r["level"] for r in top.collect())
    return Bins(edges, levels, size)


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. ``left_bins`` says which bins of the feature go left."""
    feature: np.ndarray
    left: np.ndarray
    right: np.ndarray
    left_bins: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        live = np.arange(len(codes)) if self.feature[0] >= 0 else np.array([], np.int64)
        while len(live):
            node = at[live]
            node = np.where(self.left_bins[node, codes[live, self.feature[node]]], self.left[node], self.right[node])
            at[live] = node
            live = live[self.feature[node] >= 0]
        return at


@dataclass
class Run:
    """A booster: rows of fold ``held_out`` are not learned from, splits use ``features`` only."""
    features: tuple[str, ...]
    held_out: int | None = None
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit ids and a salt."""
    x = x.view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss in units of ``UNIT``, as whole numbers."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) / UNIT), np.rint(p * (1.0 - p) / UNIT)


def tree_features(run: Run, names: Sequence[str], s: Settings, t: int) -> np.ndarray:
    """Feature numbers that tree ``t`` may split on: the share of the run's features with the smallest draws."""
    draw = np.random.default_rng([s.seed, t]).random(len(names))
    mine = [i for i, f in enumerate(names) if f in run.features]
    return np.array(sorted(sorted(mine, key=lambda i: (draw[i], i))[:max(1, round(s.feature_share * len(mine)))]), np.int64)


def best_split(hist: np.ndarray, features: np.ndarray, n_cats: int, s: Settings):
    """(gain, feature, bins that go left) of the best split of a leaf, or None. ``hist``: features x bins x (g, h, n), whole
    numbers. Numbers are cut between bins with the missing ones on the better side (right if equal); categories are
    ordered by their mean gradient and cut in that order. Ties: first feature, first cut."""
    def gains(left, total, lam):
        """``left``: sums of the left side of every cut, the last axis is (g, h, n)."""
        right = total - left
        strength = [np.maximum(np.abs(x[..., 0] * UNIT) - s.alpha, 0.0) ** 2 / (x[..., 1] * UNIT + lam) for x in (left, right, total)]
        return np.where((left[..., 2] >= s.min_child) & (right[..., 2] >= s.min_child), strength[0] + strength[1] - strength[2], -np.inf)

    best, total, n_bins = None, hist[0].sum(axis=0), hist.shape[1]
    if total[2] < 2 * s.min_child:
        return None
    for f in features[features < n_cats]:
        seen = np.flatnonzero(hist[f, :, 2])
        if len(seen) > 1:
            order = seen[np.argsort(hist[f, seen, 0] * UNIT / (hist[f, seen, 1] * UNIT + s.cat_smooth), kind="stable")]
            gain = gains(np.cumsum(hist[f, order], axis=0)[:-1], total, s.lam + s.cat_lam)
            cut = int(gain.argmax())
            if gain[cut] > 1e-9 and (best is None or gain[cut] > best[0]):
                best = (float(gain[cut]), int(f), np.isin(np.arange(n_bins), order[:cut + 1]))
    nums = features[features >= n_cats]
    if len(nums):
        both = np.cumsum(hist[nums], axis=1)[:, :-1]
        gain = np.stack([gains(both - hist[nums, :1], total, s.lam), gains(both, total, s.lam)], axis=1)
        i, missing_left, cut = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, missing_left, cut] > 1e-9 and (best is None or gain[i, missing_left, cut] > best[0]):
            left = np.arange(n_bins) <= cut
            left[0] = missing_left == 1
            best = (float(gain[i, missing_left, cut]), int(nums[i]), left)
    return best


class Growing:
    """A tree whose leaves are split in best-first order as their histograms arrive."""

    def __init__(self, features: np.ndarray, n_cats: int, settings: Settings):
        self.features, self.n_cats, self.s = features, n_cats, settings
        self.hist: list[np.ndarray | None] = [None]
        self.split: list = [None]
        self.depth = [0]
        self.children: dict[int, tuple[int, int]] = {}
        self.wanted = {0: None}                       # counted node -> (parent, sibling)

    def put(self, found: Mapping[int, np.ndarray], empty: np.ndarray) -> None:
        """Histograms of the counted nodes; siblings follow by subtraction."""
        for node, family in self.wanted.items():
            self._know(node, found.get(node, empty))
            if family:
                parent, sibling = family
                self._know(sibling, self.hist[parent] - self.hist[node])
                self.hist[parent] = self.hist[parent][:1].copy()    # its first feature keeps the totals
        self.wanted = {}
        for node in self._reached():
            if node not in self.children:
                left, right = len(self.hist), len(self.hist) + 1
                self.hist += [None, None]
                self.split += [None, None]
                self.depth += [self.depth[node] + 1] * 2
                self.children[node] = (left, right)
                _, f, bins = self.split[node]
                n = self.hist[node][f, :, 2]
                first = n[bins].sum() <= n[~bins].sum()
                self.wanted[left if first else right] = (node, right if first else left)

    def _know(self, node: int, hist: np.ndarray) -> None:
        self.hist[node] = hist
        if self.s.max_depth is None or self.depth[node] < self.s.max_depth:
            self.split[node] = best_split(hist, self.features, self.n_cats, self.s)

    def _reached(self) -> list[int]:
        """Nodes that the best-first order splits, as far as histograms are known."""
        heap = [(-self.split[0][0], 0)] if self.split[0] else []
        out = []
        while heap and len(out) < self.s.leaves - 1:
            _, node = heapq.heappop(heap)
            out.append(node)
            for child in self.children.get(node, ()):
                if self.split[child]:
                    heapq.heappush(heap, (-self.split[child][0], child))
        return out

    def tree(self) -> Tree:
        """The nodes split so far; every other one is a leaf with its shrunken Newton step."""
        inner = set(self._reached()) & set(self.children)
        n, bins = len(self.hist), self.hist[0].shape[1]
        out = Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, bins), bool), np.zeros(n))
        for node in range(n):
            if node in inner:
                out.feature[node], out.left_bins[node] = self.split[node][1:]
                out.left[node], out.right[node] = self.children[node]
            elif self.hist[node] is not None:
                g, h, _ = self.hist[node][0].sum(axis=0)
                g, h = g * UNIT, h * UNIT
                out.value[node] = -self.s.step * np.sign(g) * max(abs(g) - self.s.alpha, 0.0) / (h + self.s.lam)
        return out


def _arrays(batch: pa.RecordBatch, n_features: int, n_runs: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, n_features)
    margin = np.frombuffer(b"".join(batch.column("margin").to_pylist()), np.float64).reshape(-1, n_runs).copy()
    return codes, margin


def _add(margin: np.ndarray, codes: np.ndarray, trees: Iterable[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.leaves(codes)]
    return margin


def _histograms(state: DataFrame, runs: list[Run], growing: list[Growing], done: int, t: int, n_features: int, s: Settings) -> list[dict[int, np.ndarray]]:
    """Per run: histograms of the nodes its growing tree wants, over all rows. ``done``: trees whose values are
    in the stored margins already."""
    live = [(i, run.held_out, run.trees[done:], g.tree() if g.hist[0] is not None else None, list(g.wanted))
            for i, (run, g) in enumerate(zip(runs, growing)) if g.wanted]
    size, n_runs, cells = s.max_bins, len(runs), n_features * s.max_bins

    def run_task(batches):
        sums = {i: np.zeros((len(nodes) * cells, 3), np.int64) for i, *_, nodes in live}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, margin = _arrays(batch, n_features, n_runs)
            y, fold, key = (batch.column(c).to_numpy() for c in ("y", "fold", "key"))
            flat = codes + np.arange(n_features) * size
            drawn = _mix(key, s.seed * 1_000_003 + t) < s.subsample
            for i, held_out, trees, tree, nodes in live:
                mine = np.flatnonzero(drawn & (fold != held_out) if held_out is not None else drawn)
                slot = np.zeros(len(mine), np.int64)
                if tree is not None:
                    place = np.full(len(tree.feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    slot = place[tree.leaves(codes[mine])]
                    mine, slot = mine[slot >= 0], slot[slot >= 0]
                if len(mine):
                    g, h = gradients(_add(margin[mine, i], codes[mine], trees), y[mine])
                    cell = (flat[mine] + slot[:, None] * cells).ravel()
                    for j, v in enumerate((g, h)):
                        sums[i][:, j] += np.bincount(cell, np.repeat(v, n_features), len(sums[i])).astype(np.int64)
                    sums[i][:, 2] += np.bincount(cell, minlength=len(sums[i]))
        for i, *_, nodes in live:
            full = np.flatnonzero(sums[i][:, 2])
            if len(full):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), i), pa.int32()), pa.array(np.array(nodes)[full // cells], pa.int32()),
                     pa.array(full % cells, pa.int32()), *[pa.array(sums[i][full, j], pa.int64()) for j in range(3)]],
                    names=["run", "node", "cell", "g", "h", "n"])

    parts = state.select("key", "y", "fold", "codes", "margin").mapInArrow(run_task, "run int, node int, cell int, g long, h long, n long")
    rows = parts.groupBy("run", "node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out: list[dict[int, np.ndarray]] = [{} for _ in runs]
    run, node, cell = (rows.column(c).to_numpy() for c in ("run", "node", "cell"))
    values = np.stack([rows.column(c).to_numpy() for c in ("g", "h", "n")], axis=1)
    for i, *_, nodes in live:
        for nd in nodes:
            at = (run == i) & (node == nd)
            hist = np.zeros((cells, 3), np.int64)
            hist[cell[at]] = values[at]
            out[i][nd] = hist.reshape(n_features, size, 3)
    return out


class Store:
    """The binned rows with their margins, in two folders written in turn: one is read while the other is replaced.
    A task reads about ``TASK_ROWS`` rows: the first write deals them over as many files."""

    def __init__(self, spark: SparkSession, rows: int):
        self.spark, self.turn, self.tasks = spark, 0, -(-max(rows, 1) // TASK_ROWS)
        self.base = scratch_path(spark, f"boost-{uuid.uuid4().hex}")

    def write(self, df: DataFrame) -> DataFrame:
        self.turn = 1 - self.turn
        path = f"{self.base}/{self.turn}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).coalesce(self.tasks)


def _advance(store: Store, state: DataFrame, runs: list[Run], done: int, n_features: int) -> DataFrame:
    """Stored rows with the values of all trees since ``done`` added to their margins."""
    trees, n_runs = [run.trees[done:] for run in runs], len(runs)

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                codes, margin = _arrays(batch, n_features, n_runs)
                for i in range(n_runs):
                    margin[:, i] = _add(margin[:, i], codes, trees[i])
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array([m.tobytes() for m in margin], pa.binary()))

    return store.write(state.mapInArrow(task, state.schema))


@dataclass
class Boosted:
    """Fitted runs, the bins they share, and the training rows (key, y, fold, codes, margin per run, and the carried columns
    under the names that ``carried`` gives, so that they clash with nothing)."""
    runs: list[Run]
    bins: Bins
    rows: DataFrame
    carried: dict[str, str]

    def scores(self, ids: Sequence[str], out: Sequence[str], pick: Sequence[Sequence[int]]) -> DataFrame:
        """Probabilities of the training rows: column ``out[j]`` of a row in fold f is that of run ``pick[j][f]``."""
        n_runs, picks = len(self.runs), [np.array(p) for p in pick]
        held = [self.carried[c] for c in ids]
        schema = ", ".join([*[f"{c} {self.rows.schema[c].dataType.simpleString()}" for c in held], *[f"_s{j} double" for j in range(len(out))]])

        def task(batches):
            for batch in batches:
                if batch.num_rows:
                    margin = np.frombuffer(b"".join(batch.column("margin").to_pylist()), np.float64).reshape(-1, n_runs)
                    fold = batch.column("fold").to_numpy()
                    cols = [1.0 / (1.0 + np.exp(-margin[np.arange(len(fold)), p[fold]])) for p in picks]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], *map(pa.array, cols)],
                                                     names=[*held, *[f"_s{j}" for j in range(len(cols))]])

        return self.rows.select("fold", "margin", *held).mapInArrow(task, schema).toDF(*ids, *out)

    def predict(self, df: DataFrame, ids: Sequence[str], out: str = "score", run: int = 0) -> DataFrame:
        """(ids…, out): probability of rows not seen in training; missing and unknown values follow bin 0."""
        bins, model = self.bins, self.runs[run]
        ship_package(df.sparkSession)
        schema = ", ".join([*[f"`id{i}` {f.dataType.simpleString()}" for i, f in enumerate(df.select(*ids).schema)], f"`{out}` double"])

        def task(batches):
            for batch in batches:
                if batch.num_rows:
                    margin = _add(np.full(batch.num_rows, model.start), bins.codes(batch), model.trees)
                    yield pa.RecordBatch.from_arrays([*[batch.column(f"id{i}") for i in range(len(ids))], pa.array(1.0 / (1.0 + np.exp(-margin)))],
                                                     names=[*[f"id{i}" for i in range(len(ids))], out])

        rows = df.select(*[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)], *feature_columns(list(bins.levels), list(bins.numbers)))
        return rows.mapInArrow(task, schema).toDF(*ids, out)


def fit(df: DataFrame, cats: Sequence[str], nums: Sequence[str], key: str, label: str = "y", fold: str | None = None,
        runs: Sequence[Run] | None = None, keep: Sequence[str] = (), bins: Bins | None = None, settings: Settings = Settings()) -> Boosted:
    """Fit all ``runs`` (default: one on all rows and features) together. Rows need a label of 0 or 1; others are left
    out. ``keep``: further columns carried along for ``Boosted.scores``. Without a row of each label a run has no trees and
    scores the (clipped) share of its label."""
    spark, s = df.sparkSession, settings
    ship_package(spark)
    df = df.where(F.col(label).isin(0, 1))
    bins = bins or fit_bins(df, cats, nums, s.max_bins)
    names = bins.features
    runs = [Run(tuple(names))] if runs is None else list(runs)
    number = F.col(fold).cast("int") if fold else F.lit(0)
    totals = df.groupBy(number.alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).collect()
    for run in runs:
        n, pos = (sum(r[c] for r in totals if run.held_out is None or r["fold"] != run.held_out) for c in ("n", "pos"))
        p = min(max(pos / n if n else 0.5, 1e-6), 1 - 1e-6)
        run.start, run.trees = float(np.log(p / (1 - p))), []
    starts = np.array([run.start for run in runs]).tobytes()
    carried = list(dict.fromkeys([key, *keep]))
    base = df.select(F.xxhash64(key).alias("_key"), F.col(label).cast("int").alias("_y"), number.alias("_fold"),
                     *[F.col(c).alias(f"_id{i}") for i, c in enumerate(carried)],
                     *feature_columns(cats, nums))
    types = {f"_id{i}": df.schema[c].dataType.simpleString() for i, c in enumerate(carried)}
    schema = "key long, y int, fold int, codes binary, margin binary, " + ", ".join(f"{c} {t}" for c, t in types.items())

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                codes = bins.codes(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key"), batch.column("_y"), batch.column("_fold"), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array([starts] * batch.num_rows, pa.binary()), *[batch.column(c) for c in types]],
                    names=["key", "y", "fold", "codes", "margin", *types])

    store = Store(spark, sum(r["n"] for r in totals))
    state = store.write(base.repartition(store.tasks).mapInArrow(encode, schema))
    done, empty = 0, np.zeros((len(names), s.max_bins, 3), np.int64)
    for t in range(s.rounds):
        growing = [Growing(tree_features(run, names, s, t), len(bins.levels), s) for run in runs]
        while any(g.wanted for g in growing):
            for g, found in zip(growing, _histograms(state, runs, growing, done, t, len(names), s)):
                if g.wanted:
                    g.put(found, empty)
        for run, g in zip(runs, growing):
            run.trees.append(g.tree())
        if t + 1 - done >= s.refresh or t + 1 == s.rounds:
            state, done = _advance(store, state, runs, done, len(names)), t + 1
    return Boosted(runs, bins, state, {c: f"_id{i}" for i, c in enumerate(carried)})


def oof_scores(df: DataFrame, cats: Sequence[str], variants: Mapping[str, Sequence[str]], key: str, fold: str, k: int = 5,
               label: str = "y", settings: Settings = Settings()) -> DataFrame:
    """M11 and M13 together: (key, label, one column per variant) with out-of-fold probabilities. ``variants``: name -> its numeric
    features (all categories are in each). All k folds of all variants are fitted in the same passes."""
    nums = list(dict.fromkeys(c for v in variants.values() for c in v))
    runs = [Run((*cats, *v), f) for v in variants.values() for f in range(k)]
    b = fit(df, cats, nums, key, label, fold, runs, keep=[label], settings=settings)
    return b.scores([key, label], list(variants), [list(range(i * k, (i + 1) * k)) for i in range(len(variants))])


def root_split(model: Boosted, s: Settings) -> float | None:
    """Gain of the best first split of the first run on all its rows and features, None without one."""
    names = model.bins.features
    growing = [Growing(np.arange(len(names)), len(model.bins.levels), s) for _ in model.runs]
    for other in growing[1:]:
        other.wanted = {}
    grow, every = growing[0], replace(s, subsample=1.0)
    grow.put(_histograms(model.rows, model.runs, growing, 0, 0, len(names), every)[0], np.zeros((len(names), s.max_bins, 3), np.int64))
    return grow.split[0][0] if grow.split[0] else None


def bin_counts(df: DataFrame, bins: Bins, label: str = "y") -> DataFrame:
    """(variable, bin, n, n_pos): rows and positive labels per bin, the histogram at the root of every first tree. Sums are
    made in the tasks; features x bins rows of each travel. A missing label counts as a row."""
    ship_package(df.sparkSession)
    names, size = bins.features, bins.size

    def task(batches):
        sums = np.zeros((len(names) * size, 2), np.int64)
        for batch in batches:
            cell = (bins.codes(batch) + np.arange(len(names)) * size).ravel()
            sums[:, 0] += np.bincount(cell, minlength=len(sums))
            pos = np.repeat(batch.column("_y").to_numpy(zero_copy_only=False).astype(np.float64), len(names))
            sums[:, 1] += np.bincount(cell, pos, len(sums)).astype(np.int64)
        full = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array([names[i // size] for i in full], pa.string()), pa.array(full % size, pa.int32()),
                                          pa.array(sums[full, 0]), pa.array(sums[full, 1])], names=["variable", "bin", "n", "n_pos"])

    rows = df.select(F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("_y"), *feature_columns(list(bins.levels), list(bins.numbers)))
    return rows.mapInArrow(task, "variable string, bin int, n long, n_pos long") \
        .groupBy("variable", "bin").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
