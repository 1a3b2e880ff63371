"""Attribution (I1-I7). Contributions are handled in long form
(row, variable, value, contribution); every summary is a grouped aggregate over it."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .order import exact_quantiles
from .relational import sample_seeded

DIRECTION_BAND = 0.05   # fixed value: |corr| below this is "non-monotone"


def importance_table(contrib: DataFrame) -> DataFrame:
    """Mean |contribution| per variable, share % and cumulative % (descending)."""
    imp = contrib.groupBy("variable").agg(F.avg(F.abs("contribution")).alias("importance"))
    w_all = Window.partitionBy(F.lit(0))                       # one row per variable
    w_cum = Window.orderBy(F.col("importance").desc(), F.col("variable")).rowsBetween(Window.unboundedPreceding, 0)
    return (imp.withColumn("share_pct", 100 * F.try_divide(F.col("importance"), F.sum("importance").over(w_all)))
            .withColumn("cum_pct", 100 * F.try_divide(F.sum("importance").over(w_cum), F.sum("importance").over(w_all))))


def effect_direction(contrib: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """Sign of corr(value, contribution) per variable; zero variance → 0. A variable of ``categorical`` has no
    direction: its value is a code, so it is marked "categorical" and has no correlation."""
    c = contrib.groupBy("variable").agg(
        F.when((F.stddev_pop("value") == 0) | (F.stddev_pop("contribution") == 0), F.lit(0.0))
        .otherwise(F.coalesce(F.corr("value", "contribution"), F.lit(0.0))).alias("corr"))
    code = F.col("variable").isin(*categorical) if categorical else F.lit(False)
    return c.withColumn("corr", F.when(~code, F.col("corr"))).withColumn("direction", F.when(code, "categorical").when(F.col("corr") > DIRECTION_BAND, "up")
                        .when(F.col("corr") < -DIRECTION_BAND, "down").otherwise("non-monotone"))


def rank_stability(contrib: DataFrame, fold: str = "fold") -> DataFrame:
    """Importance rank of each variable in each fold (1 = most important, ties get
    the mean rank), then mean and sample std of the rank across folds."""
    f = contrib.groupBy(fold, "variable").agg(F.avg(F.abs("contribution")).alias("imp"))
    w = Window.partitionBy(fold).orderBy(F.col("imp").desc())   # ≤ variables rows per fold
    wt = Window.partitionBy(fold, "imp")
    rk = f.withColumn("rnk", F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)
    return rk.groupBy("variable").agg(F.avg("rnk").alias("mean_rank"), F.stddev_samp("rnk").alias("std_rank"))


def dependence_points(contrib: DataFrame, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """(value, contribution) points inside the [lo, hi] percentile band of the value."""
    q = exact_quantiles(contrib, "value", [lo, hi], by=["variable"])
    b = q.groupBy("variable").agg(F.max(F.when(F.col("q") == lo, F.col("value"))).alias("_lo"),
                                  F.max(F.when(F.col("q") == hi, F.col("value"))).alias("_hi"))
    # b has one row per variable: bounded
    return (contrib.join(F.broadcast(b), "variable").where((F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi")))
            .drop("_lo", "_hi"))


def top_overlap(contrib: DataFrame, with_label: DataFrame, k1: int, k2: int, label: str = "y") -> DataFrame:
    """Overlap of the top-k1 variables by mean |contribution| and the top-k2 by
    |corr(value, label)|."""
    a = (contrib.groupBy("variable").agg(F.avg(F.abs("contribution")).alias("s"))
         .orderBy(F.col("s").desc(), "variable").limit(k1).select("variable"))
    b = (with_label.groupBy("variable").agg(F.abs(F.corr("value", label)).alias("s"))
         .orderBy(F.col("s").desc_nulls_last(), "variable").limit(k2).select("variable"))
    both = a.intersect(b)
    return both.agg(F.count(F.lit(1)).alias("overlap"),
                    F.array_join(F.array_sort(F.collect_list("variable")), ",").alias("variables"))


def coefficients(spark: SparkSession, model: PipelineModel, sample: DataFrame) -> DataFrame:
    """I4: coefficient, |coefficient| and odds ratio per assembled attribute, sorted.
    Attribute names come from the ``features`` column metadata (schema only)."""
    lr = [s for s in model.stages if isinstance(s, LogisticRegressionModel)][0]
    meta = model.transform(sample.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    coef = lr.coefficients.toArray()
    rows = [(names.get(i, f"f{i}"), float(c), float(abs(c)), float(math.exp(c))) for i, c in enumerate(coef)]
    rows.append(("(intercept)", float(lr.intercept), float(abs(lr.intercept)), float(math.exp(lr.intercept))))
    df = spark.createDataFrame(rows, "attribute string, coefficient double, abs_coefficient double, odds_ratio double")
    return df.orderBy(F.col("abs_coefficient").desc(), "attribute")


# ---------------------------------------------------------------- I1: tree attribution
def extract_trees(tree_model) -> list[dict]:
    """Flatten a fitted MLlib tree ensemble (GBT / RF) into plain arrays per tree:
    feature, threshold or left-category set, children, leaf value, cover, tree weight.
    This is model state (bounded by trees × nodes), read once on the driver."""
    jtrees = tree_model._java_obj.trees()
    weights = list(tree_model.treeWeights)
    out = []
    for t in range(len(jtrees)):
        nodes = []
        stack = [(jtrees[t].rootNode(), -1, False)]
        while stack:
            node, parent, is_left = stack.pop()
            idx = len(nodes)
            rec = {"left": -1, "right": -1, "feat": -1, "thr": 0.0, "cats": None,
                   "value": float(node.prediction()), "cover": float(node.impurityStats().count())}
            nodes.append(rec)
            if parent >= 0:
                nodes[parent]["left" if is_left else "right"] = idx
            if node.getClass().getSimpleName() == "InternalNode":
                sp = node.split()
                rec["feat"] = int(sp.featureIndex())
                if sp.getClass().getSimpleName() == "ContinuousSplit":
                    rec["thr"] = float(sp.threshold())
                else:
                    rec["cats"] = {float(c) for c in sp.leftCategories()}
                stack.append((node.rightChild(), idx, False))
                stack.append((node.leftChild(), idx, True))
        out.append({"nodes": nodes, "weight": float(weights[t])})
    return out


@dataclass
class LeafPath:
    """One leaf of a tree: its weighted value and, per distinct feature on its path, what the feature must satisfy
    (above ``low``, up to ``high``, in or out of category sets) and the share of training rows that did."""
    value: float
    feats: list[int] = field(default_factory=list)
    low: list[float | None] = field(default_factory=list)
    high: list[float | None] = field(default_factory=list)
    cats: list[list[tuple[list[float], bool]]] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def step(self, node: dict, left: bool, share: float) -> LeafPath:
        """The path after one more split."""
        p = LeafPath(self.value, list(self.feats), list(self.low), list(self.high), [list(c) for c in self.cats], list(self.share))
        if node["feat"] not in p.feats:
            p.feats.append(node["feat"])
            p.low.append(None)
            p.high.append(None)
            p.cats.append([])
            p.share.append(1.0)
        i = p.feats.index(node["feat"])
        p.share[i] *= share
        if node["cats"] is not None:
            p.cats[i].append((sorted(node["cats"]), left))
        elif left:
            p.high[i] = node["thr"] if p.high[i] is None else min(p.high[i], node["thr"])
        else:
            p.low[i] = node["thr"] if p.low[i] is None else max(p.low[i], node["thr"])
        return p

    def met(self, x: np.ndarray) -> np.ndarray:
        """(rows, path features): which conditions each row meets; a missing value goes right at a threshold."""
        out = np.ones((len(x), len(self.feats)), dtype=bool)
        for i, f in enumerate(self.feats):
            v = x[:, f]
            if self.low[i] is not None:
                out[:, i] &= ~(v <= self.low[i])
            if self.high[i] is not None:
                out[:, i] &= v <= self.high[i]
            for levels, inside in self.cats[i]:
                out[:, i] &= np.isin(v, levels) == inside
        return out

    def shapley(self, met: np.ndarray) -> np.ndarray:
        """(patterns, path features): Shapley values of the leaf. With a set S of known features the leaf counts with
        the product of ``met`` over S and of ``share`` over the rest; per feature the sums over all S of one size
        are the coefficients of a polynomial in the others."""
        m, one = len(self.feats), met.astype(float)
        out = np.zeros(met.shape)
        for f in range(m):
            by_size = np.zeros((len(met), m))
            by_size[:, 0] = 1.0
            for j in range(m):
                if j != f:
                    by_size[:, 1:] = by_size[:, 1:] * self.share[j] + by_size[:, :-1] * one[:, j, None]
                    by_size[:, 0] *= self.share[j]
            weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
            out[:, f] = self.value * (one[:, f] - self.share[f]) * (by_size @ np.array(weight))
        return out


def leaf_paths(trees: list[dict]) -> list[LeafPath]:
    """All leaves of the ensemble that have a split above them (model state: one entry a leaf)."""
    out = []
    for tr in trees:
        nodes = tr["nodes"]
        stack = [(0, LeafPath(0.0))]
        while stack:
            j, path = stack.pop()
            nd = nodes[j]
            if nd["feat"] < 0:
                path.value = tr["weight"] * nd["value"]
                if path.feats and path.value:
                    out.append(path)
                continue
            for child, left in ((nd["left"], True), (nd["right"], False)):
                stack.append((child, path.step(nd, left, nodes[child]["cover"] / nd["cover"])))
    return out


#: Path features up to which a leaf's Shapley values are tabulated for all patterns beforehand (2^8 rows).
TABLE_FEATURES = 8


def contributions(x: np.ndarray, paths: list[LeafPath], tables: list[np.ndarray | None]) -> np.ndarray:
    """(rows, features) of a batch: each leaf looks up its value by the pattern of conditions the rows meet."""
    phi = np.zeros(x.shape)
    for p, table in zip(paths, tables, strict=True):
        met = p.met(x)
        code = met @ (1 << np.arange(len(p.feats), dtype=np.int64))
        if table is None:         # a long path: only the patterns that occur
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            table = p.shapley(met[first])
        phi[:, p.feats] += table[code]
    return phi


def pattern_tables(paths: list[LeafPath]) -> list[np.ndarray | None]:
    out = []
    for p in paths:
        m = len(p.feats)
        out.append(p.shapley((np.arange(1 << m)[:, None] >> np.arange(m)) & 1 == 1) if m <= TABLE_FEATURES else None)
    return out


def expected_margin(trees) -> float:
    """Base value: Σ tree weight × cover-weighted mean leaf value."""
    base = 0.0
    for tr in trees:
        nodes = tr["nodes"]
        root = nodes[0]["cover"]
        base += tr["weight"] * sum(n["value"] * n["cover"] / root for n in nodes if n["feat"] < 0)
    return base


def tree_attribution(pipeline: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """Per-row additive contribution of every assembled attribute for a tree ensemble: exact path-dependent
    Shapley values in margin space, contributions + base = margin.

    The model becomes its list of leaves (bounded by trees × leaves, sent to the tasks), each with one condition per
    distinct feature on its path. Rows stay in their partition: a batch is compared with one leaf at a time, and the
    pattern of conditions met picks the leaf's contribution. Output: (key, attribute, contribution, base)."""
    spark = df.sparkSession
    ship_package(spark)
    tm = [s for s in pipeline.stages if isinstance(s, (GBTClassificationModel, RandomForestClassificationModel))][0]
    prepared = pipeline.transform(df)
    meta = prepared.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for grp in meta.values() for a in grp}
    nf = tm.numFeatures
    trees = extract_trees(tm)
    base = expected_margin(trees)
    bc = spark.sparkContext.broadcast(leaf_paths(trees))
    name_df = spark.createDataFrame([(i, names.get(i, f"f{i}")) for i in range(nf)], "idx int, attribute string")

    def run(it):
        paths = bc.value
        tables = pattern_tables(paths)
        for pdf in it:
            x = np.array(pdf["_x"].tolist(), dtype=np.float64).reshape(len(pdf), nf)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), nf), "idx": np.tile(np.arange(nf, dtype=np.int32), len(pdf)),
                                "contribution": contributions(x, paths, tables).ravel()})

    kt = df.schema[key].dataType.simpleString()
    out = prepared.select(key, vector_to_array("features").alias("_x")).mapInPandas(
        run, f"{key} {kt}, idx int, contribution double")
    return out.join(F.broadcast(name_df), "idx").select(key, "attribute", "contribution", F.lit(base).alias("base"))   # one row a feature


def refit_stability(df: DataFrame, fold: str, key: str, fit: Callable[[DataFrame], PipelineModel], k: int = 5,
                    sample: int = 3000, seed: int = 42, variable_of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Importance ranks under refitting. Per fold a model is fitted on the other folds and attributed on
    ``sample`` of its training rows (by keyed hash); then mean and sample std of each variable's rank across folds.
    ``variable_of`` maps an assembled attribute to the variable it belongs to."""
    parts = []
    for f in range(k):     # k fits, each a distributed job; callers pass a materialized frame
        train = df.where(F.col(fold) != f)
        c = tree_attribution(fit(train), sample_seeded(train, key, sample, seed), key)
        c = c.withColumn("variable", variable_of(F.col("attribute"))).groupBy(key, "variable").agg(F.sum("contribution").alias("contribution"))
        parts.append(c.withColumn(fold, F.lit(f)))
    return rank_stability(functools.reduce(DataFrame.unionByName, parts), fold)


def coefficient_overlap(contrib: DataFrame, coefs: DataFrame, k1: int, k2: int, variable_of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The k1 variables with the largest mean |contribution| against the variables of the k2 attributes with the
    largest |coefficient| of a linear model (``coefficients``, its intercept left out): size and names of the overlap."""
    a = contrib.groupBy("variable").agg(F.avg(F.abs("contribution")).alias("s")).orderBy(F.col("s").desc(), "variable").limit(k1).select("variable")
    b = coefs.where("attribute <> '(intercept)'").orderBy(F.col("abs_coefficient").desc(), "attribute").limit(k2) \
        .select(variable_of(F.col("attribute")).alias("variable")).distinct()
    return a.join(b, "variable", "left_semi").agg(F.count(F.lit(1)).alias("overlap"), F.array_join(F.array_sort(F.collect_list("variable")), ",").alias("variables"))
