"""Batched leaf-wise boosting against a plain booster that tries every cut on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import boosting as B

SMALL = dict(rounds=4, leaves=6, min_child=8, max_bins=16, refresh=2, step=0.3)
COLUMNS = "id long, a double, b double, c string, y int, fold int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        a, b, c = float(rng.normal()), float(rng.integers(0, 5)), "uvwxz"[int(rng.integers(0, 5))]
        y = int(a + (c in "ux") * 1.2 - 0.3 * b + rng.normal(scale=0.7) > 0)
        if rng.random() < 0.15:
            a, y = None, int(rng.random() < 0.8)
        rows.append((i, a, b if rng.random() > 0.05 else float("nan"), c if rng.random() > 0.05 else None, y, i % 3))
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def stored(model):
    rows = sorted(model.rows.collect(), key=lambda r: r["_id0"])
    codes = np.array([list(r["codes"]) for r in rows])
    margins = np.array([np.frombuffer(bytes(r["margin"])) for r in rows])
    return rows, codes, margins


def plain_booster(codes, y, keys, s, n_cats, train, features=None):
    """Margins of all rows; every leaf tries every cut by summing its rows."""
    def strength(g, h, lam):
        return max(abs(g) - s.alpha, 0) ** 2 / (h + lam)

    def cuts(rows, g, h, allowed):
        best = None
        for f in allowed:
            v = codes[rows, f]
            if f < n_cats:
                lam = s.lam + s.cat_lam
                order = sorted(set(v), key=lambda b: (g[rows][v == b].sum() / (h[rows][v == b].sum() + s.cat_smooth), b))
                lefts = [set(order[:i]) for i in range(1, len(order))]
            else:
                lam = s.lam
                lefts = [set(range(1, t + 1)) for t in range(1, s.max_bins - 1)] + [set(range(0, t + 1)) for t in range(0, s.max_bins - 1)]
            for left in lefts:
                m = np.isin(v, list(left))
                if min(m.sum(), (~m).sum()) < s.min_child:
                    continue
                gain = strength(g[rows][m].sum(), h[rows][m].sum(), lam) + strength(g[rows][~m].sum(), h[rows][~m].sum(), lam) \
                    - strength(g[rows].sum(), h[rows].sum(), lam)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, left)
        return best

    p = y[train].mean()
    margin = np.full(len(y), math.log(p / (1 - p)))
    names = codes.shape[1]
    for t in range(s.rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        drawn = train & (B._mix(keys, s.seed * 1_000_003 + t) < s.subsample)
        run = B.Run(tuple(features if features is not None else range(names)))
        allowed = B.tree_features(run, list(range(names)), s, t)
        leaves = [(np.flatnonzero(drawn), np.arange(len(y)))]
        found = [cuts(leaves[0][0], g, h, allowed)]
        while len(leaves) < s.leaves and any(found):
            i = max((i for i in range(len(leaves)) if found[i]), key=lambda i: found[i][0])
            _, f, left = found[i]
            (rows, every) = leaves.pop(i)
            found.pop(i)
            for side in (True, False):
                part = tuple(x[np.isin(codes[x, f], list(left)) == side] for x in (rows, every))
                leaves.append(part)
                found.append(cuts(part[0], g, h, allowed))
        for rows, every in leaves:
            gs, hs = g[rows].sum(), h[rows].sum()
            margin[every] -= s.step * np.sign(gs) * max(abs(gs) - s.alpha, 0) / (hs + s.lam)
    return margin


def test_equals_plain_booster(table):
    s = B.Settings(**SMALL)
    model = B.fit(table, ["c"], ["a", "b"], "id", settings=s)
    rows, codes, margins = stored(model)
    y = np.array([r["y"] for r in rows])
    keys = np.array([r["key"] for r in rows], np.int64)
    want = plain_booster(codes, y, keys, s, 1, np.ones(len(y), bool))
    assert np.allclose(margins[:, 0], want, atol=1e-6)
    assert any((t.feature >= 0).sum() > 3 for t in model.runs[0].trees)


def test_predict_equals_stored_margins_and_takes_unknown_values(spark, table):
    s = B.Settings(**SMALL)
    model = B.fit(table, ["c"], ["a", "b"], "id", settings=s)
    rows, _, margins = stored(model)
    got = {r["id"]: r["score"] for r in model.predict(table, ["id"]).collect()}
    assert all(got[r["_id0"]] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-12) for r, m in zip(rows, margins[:, 0]))
    odd = spark.createDataFrame([(1, None, None, None, 0, 0), (2, float("nan"), float("nan"), "never seen", 0, 0)], COLUMNS)
    a, b = (r["score"] for r in model.predict(odd, ["id"]).orderBy("id").collect())
    assert a == b and 0 < a < 1


def test_folds_and_ablation_in_one_pass_equal_separate_fits(table):
    """The same scores to the last bit, in any partitioning."""
    s = B.Settings(**SMALL)
    both = B.oof_scores(table, ["c"], {"full": ["a", "b"], "without_a": ["b"]}, "id", "fold", 3, settings=s)
    got = {r["id"]: r for r in both.collect()}
    assert len(got) == 600
    bins = B.fit_bins(table, ["c"], ["a", "b"], s.max_bins)
    for name, features in (("full", ("c", "a", "b")), ("without_a", ("c", "b"))):
        for f in (0, 2):
            one = B.fit(table.repartition(2), ["c"], ["a", "b"], "id", fold="fold", runs=[B.Run(features, f)], bins=bins, settings=s)
            rows, _, margins = stored(one)
            for r, m in zip(rows, margins[:, 0]):
                if r["fold"] == f:
                    assert got[r["_id0"]][name] == 1 / (1 + np.exp(-m))


def test_refresh_does_not_change_the_model(table):
    a = B.fit(table, ["c"], ["a", "b"], "id", settings=B.Settings(**SMALL))
    b = B.fit(table, ["c"], ["a", "b"], "id", bins=a.bins, settings=B.Settings(**{**SMALL, "refresh": 100}))
    assert (stored(a)[2] == stored(b)[2]).all()


def test_missing_side_is_learned(spark):
    """Missing values that behave like large ones go with them, whatever the order of bins."""
    rows = [(i, None if i % 3 == 0 else float(i % 7), int(i % 3 == 0 or i % 7 > 4)) for i in range(420)]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    model = B.fit(df, [], ["a"], "id", settings=B.Settings(rounds=1, leaves=2, min_child=5, subsample=1.0, max_bins=16, alpha=0.0))
    tree = model.runs[0].trees[0]
    assert tree.feature[0] == 0 and not tree.left_bins[0][0] and tree.left_bins[0][1]


@pytest.mark.parametrize("rows", [[], [(1, 0.5, 1)], [(1, None, None)], [(i, 1.0, 0) for i in range(50)]])
def test_degenerate_tables(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, y int")
    model = B.fit(df, [], ["a"], "id", settings=B.Settings(rounds=2, min_child=1))
    assert all((t.feature < 0).all() for t in model.runs[0].trees)
    assert model.rows.count() == sum(r[2] is not None for r in rows)


def test_histogram_cells_hold_every_row(table):
    s = B.Settings(**{**SMALL, "subsample": 1.0})
    model = B.fit(table, ["c"], ["a", "b"], "id", settings=B.Settings(**{**SMALL, "rounds": 0}))
    g = B.Growing(np.arange(3), 1, s)
    hist = B._histograms(model.rows, model.runs, [g], 0, 0, 3, s)[0][0]
    assert (hist[:, :, 2].sum(axis=1) == 600).all() and len(set(hist[:, :, 0].sum(axis=1))) == 1


def test_held_out_quality(table):
    """Out-of-fold scores of 8 rounds rank the labels well above chance."""
    from strata.operators import metrics as E
    s = B.Settings(**{**SMALL, "rounds": 8})
    oof = B.oof_scores(table, ["c"], {"score": ["a", "b"]}, "id", "fold", 3, settings=s)
    auc = E.evaluate(oof.withColumn("y", F.col("y").cast("int")), "score", "y", "id", "boost").first()
    assert auc["auc_roc"] > 0.75


def test_rows_of_one_part_are_dealt_over_tasks(spark, monkeypatch):
    """A pass has as many tasks as the rows need, also if they came in one part, and the model is the same."""
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    df = spark.range(800).select("id", (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 37 % 101 + F.col("id") % 7 > 50).cast("int").alias("y"))
    s = B.Settings(rounds=2, min_child=5)
    one, many = (B.fit(d, [], ["a"], "id", settings=s) for d in (df.coalesce(1), df.repartition(5)))
    assert one.rows.rdd.getNumPartitions() > 1
    score = lambda m: sorted(m.scores(["id"], ["p"], [[0]]).collect())
    assert score(one) == score(many)
