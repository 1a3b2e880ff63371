"""Contributions of tree ensembles against Shapley values by enumeration of all feature sets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strata.operators import attribution as I
from strata.operators import models as M


def _table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(250):
        a, b, e = (float(v) for v in rng.normal(size=3))
        cat = ["u", "v", "w", "x"][int(rng.integers(0, 4))]
        rows.append((i, a, b, e, cat, int(math.sin(2 * a) + a * b + (cat in "ux") + rng.normal(scale=0.3) > 0.5)))
    return spark.createDataFrame(rows, "k long, a double, b double, e double, c string, y int").withColumn("w", F.lit(1.0))


def _given(nodes, x, known, j=0):
    """Expected value of a tree when only the features of ``known`` are known."""
    nd = nodes[j]
    if nd["feat"] < 0:
        return nd["value"]
    if nd["feat"] in known:
        left = x[nd["feat"]] in nd["cats"] if nd["cats"] is not None else x[nd["feat"]] <= nd["thr"]
        return _given(nodes, x, known, nd["left"] if left else nd["right"])
    return sum(nodes[c]["cover"] / nd["cover"] * _given(nodes, x, known, c) for c in (nd["left"], nd["right"]))


def _shapley(trees, x):
    n, phi = len(x), np.zeros(len(x))
    value = {s: sum(t["weight"] * _given(t["nodes"], x, set(s)) for t in trees)
             for r in range(n + 1) for s in itertools.combinations(range(n), r)}
    for f in range(n):
        for s in value:
            if f not in s:
                w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                phi[f] += w * (value[tuple(sorted((*s, f)))] - value[s])
    return phi


@pytest.mark.parametrize("tabulated", [8, 0])
def test_contributions_equal_enumeration(spark, monkeypatch, tabulated):
    monkeypatch.setattr(I, "TABLE_FEATURES", tabulated)
    df = _table(spark)
    for fit in (M.gbt(["c"], ["a", "b", "e"], iters=4, depth=4), M.random_forest(["c"], ["a", "b", "e"], trees=3)):
        model = fit(df)
        tm = [s for s in model.stages if isinstance(s, (GBTClassificationModel, RandomForestClassificationModel))][0]
        trees = I.extract_trees(tm)
        rows = model.transform(df.where("k < 25")).select(vector_to_array("features").alias("x")).collect()
        x = np.array([r["x"] for r in rows])
        x[0, 1] = np.nan
        paths = I.leaf_paths(trees)
        got = I.contributions(x, paths, I.pattern_tables(paths))
        assert np.allclose(got, [_shapley(trees, v) for v in x], atol=1e-10)


def test_refits_and_coefficients(spark):
    df = _table(spark).withColumn("fold", (F.col("k") % 3).cast("int"))
    st = I.refit_stability(df, "fold", "k", M.gbt(["c"], ["a", "b", "e"], iters=3, depth=3), k=3, sample=60).collect()
    assert len(st) == 4 and {round(3 * r["mean_rank"]) for r in st} <= set(range(3, 13)) and sum(r["mean_rank"] for r in st) == pytest.approx(10)
    contrib = spark.createDataFrame([(1, "a", 1.0, 3.0), (1, "b", 1.0, -2.0), (1, "c", 1.0, 0.1), (2, "a", 2.0, 3.5), (2, "b", 2.0, -2.5), (2, "c", 2.0, 0.2)],
                                    "k long, variable string, value double, contribution double")
    coefs = spark.createDataFrame([("(intercept)", 9.0), ("a_x", 2.0), ("a_y", 1.5), ("c", 1.0), ("b", 0.5)], "attribute string, abs_coefficient double")
    o = I.coefficient_overlap(contrib, coefs, 2, 3, lambda c: F.split_part(c, F.lit("_"), F.lit(1))).first()
    assert (o["overlap"], o["variables"]) == (1, "a")
    d = {r["variable"]: (r["corr"], r["direction"]) for r in I.effect_direction(contrib, ["c"]).collect()}
    assert d["c"] == (None, "categorical") and d["a"][1] == "up" and d["b"][1] == "down"
