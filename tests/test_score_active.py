"""score_active (M18): model and calibrator are saved together and both applied to the active population."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import functions as F

from strata.operators import models as M
from strata.plans import q_models as Q
from strata.session import materialize
from strata.sources import sinks
from strata.sources.fixtures import Fixtures


def isotonic(rows):
    """Score → fitted value, by pooling adjacent violators over (score, label) pairs."""
    by = {}
    for x, y in rows:
        s, n = by.get(x, (0.0, 0))
        by[x] = s + y, n + 1
    blocks = []
    for x in sorted(by):
        blocks.append([*by[x], [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    fitted = [(x, s / n) for s, n, xs in blocks for x in xs]
    return lambda p: np.clip(np.interp(p, *zip(*fitted)), 1e-4, 1 - 1e-4)


def labelled(spark, n=400, seed=11):
    rng = np.random.default_rng(seed)
    rows = [(i, float(x), int(rng.random() < x * x), i % 4) for i, x in enumerate(rng.uniform(0, 1, n))]
    return materialize(spark.createDataFrame(rows, "k long, x double, y int, fold int").coalesce(1))


def by_key(df, *cols):
    return {r["k"]: tuple(r[c] for c in cols) for r in df.select("k", *cols).collect()}


def test_calibrator_of_out_of_fold_scores_is_saved_with_the_model(spark, tmp_path):
    df, fit = labelled(spark), M.gbt([], ["x"], iters=4, depth=2, subsample=1.0)
    oof = [(r["score"], r["y"]) for f in range(4) for r in M.positive_prob(
        fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f))).collect()]
    new = labelled(spark, 150, 12).drop("y", "fold")
    raw = by_key(M.positive_prob(fit(df).transform(new)), "score")

    saved = sinks.load_model(sinks.sink_model(M.calibrated_pipeline(df, df, fit, "fold", "y", 4), str(tmp_path / "model")))
    got, calibrate = by_key(M.calibrated_prob(saved.transform(new)), "score"), isotonic(oof)
    assert len(oof) == 400 and set(got) == set(raw)
    assert all(got[k][0] == pytest.approx(calibrate(raw[k][0]), abs=1e-9) for k in raw)
    assert any(abs(got[k][0] - raw[k][0]) > 0.01 for k in raw)


def test_scores_stay_off_zero_and_one(spark):
    """Labels that the model tells apart fully: the isotonic values are exactly 0 and 1."""
    df = labelled(spark).withColumn("y", (F.col("x") > 0.5).cast("int"))
    m = M.calibrated_pipeline(df, df, M.gbt([], ["x"], iters=2, depth=1, subsample=1.0), "fold", "y", 4)
    got = {r["score"] for r in M.calibrated_prob(m.transform(df)).collect()}
    assert {min(got), max(got)} == {1e-4, 1 - 1e-4}


def test_rows_of_one_fold_get_no_calibrator(spark):
    df, fit = labelled(spark).withColumn("fold", F.lit(2)), M.gbt([], ["x"], iters=2, depth=2, subsample=1.0)
    m = M.calibrated_pipeline(df, df, fit, "fold", "y", 4)
    assert by_key(M.calibrated_prob(m.transform(df)), "score") == by_key(M.positive_prob(fit(df).transform(df)), "score")


def test_tasks_in_threads_keep_their_order(spark):
    assert M.in_threads(spark, [lambda n=n: spark.range(n).count() for n in (5, 1, 4, 2)], 3) == [5, 1, 4, 2]
    with pytest.raises(ZeroDivisionError):
        M.in_threads(spark, [lambda: 1, lambda: 1 / 0], 2)


def portfolio_tables(spark, base):
    """Customers whose later orders depend on their history; one segment and one nation only among the active."""
    rng, customers, orders = np.random.default_rng(5), [], []
    for k in range(1, 501):
        alone = k % 25 == 0
        customers.append((k, f"c{k}", 4 if alone else k % 4, float(rng.uniform(-900, 9000)), "NEW" if alone else ["AUTO", "HOME", None][k % 3]))
        n = 2 + k % 4
        for j in range(n):
            orders.append((k * 100 + j, k, "F" if rng.random() < 0.5 else "O", float(rng.uniform(100, 5000)), dt.datetime(2000, 1 + j, 1), ["1-URGENT", "5-LOW", None][j % 3]))
        if rng.random() < n / 6:
            orders.append((k * 100 + 50, k, "O", 100.0, dt.datetime(2001, 6, 1), "5-LOW"))
    nations = [(i, f"n{i}", i % 2) for i in range(5)]
    for name, rows, schema in (
            ("customer", customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
            ("nation", nations, "n_nationkey int, n_name string, n_regionkey int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(base, f"{name}.parquet"))


def test_active_rows_get_calibrated_scores(spark, tmp_path, monkeypatch):
    portfolio_tables(spark, str(tmp_path))
    saved, fitted = [], []
    monkeypatch.setitem(Q.BOOST, "iters", 5)
    monkeypatch.setattr(sinks, "sink_model", lambda m, path, f=sinks.sink_model: saved.append(m) or f(m, path))
    monkeypatch.setattr(M, "fit_isotonic", lambda df, score, label, f=M.fit_isotonic: fitted.append([tuple(r) for r in df.select(score, label).collect()]) or f(df, score, label))
    fx = Fixtures(spark, str(tmp_path))
    got = {r["client_id"]: r["score"] for r in Q.score_active(fx).collect()}

    # every modelable labelled row was scored once by a model that had not seen its group
    base = fx.portfolio_base.where("prior_credits >= 2")
    assert len(fitted) == 1 and len(fitted[0]) == base.count()
    assert sum(y for _, y in fitted[0]) == base.agg(F.sum("y")).first()[0]
    # the saved pipeline ends with the calibrator, and the scores are its values for the model's own probabilities
    (pipeline,) = saved
    assert isinstance(pipeline.stages[-1], IsotonicRegressionModel)
    _, means = Q.FE.build_features(fx.portfolio_base)
    act, _ = Q.FE.build_features(fx.portfolio_active, means)
    raw = {r["client_id"]: r["score"] for r in M.positive_prob(PipelineModel(pipeline.stages[:-1]).transform(M.model_categoricals(act, Q.CATS))).collect()}
    assert set(got) == set(raw) == set(range(5, 501, 5)) and len(set(got.values())) > 1
    calibrate = isotonic(fitted[0])
    assert all(got[k] == pytest.approx(calibrate(raw[k]), abs=2e-6) for k in raw)
