"""Clustering measures, prior shift, splits, rare-level pooling, sinks."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import scalar as S
from strata.operators import campaign as C
from strata.operators import models as M
from strata.operators import segments as K
from strata.sources import sinks, tables


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c, center in enumerate([(0, 0), (10, 10), (-10, 10)]):
        for i in range(30):
            p = rng.normal(center, 0.1)
            rows += [(c * 100 + i, c, 0, float(p[0])), (c * 100 + i, c, 1, float(p[1]))]
    return spark.createDataFrame(rows, "id long, cluster int, dim int, value double")


def test_silhouette_and_ari_on_tight_blobs(blobs):
    assert K.silhouette(blobs, "id").first()[0] > 0.95
    lab = blobs.select("id", "cluster").distinct().withColumn("other", F.col("cluster") * 7 + 1)
    assert K.ari(lab, "cluster", "other").first()[0] == pytest.approx(1.0)
    assert K.davies_bouldin(blobs, "id").first()[0] < 0.1
    assert K.calinski_harabasz(blobs, "id").first()[0] > 1000


def test_silhouette_forms_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) + np.repeat(np.eye(3) * 2, 20, axis=0)
    lab = np.array([*np.repeat(range(3), 20)[:-1], 9])      # the last point is alone in its cluster
    df = spark.createDataFrame([(i, int(lab[i]), d, float(x[i, d])) for i in range(60) for d in range(3)],
                               "id long, cluster int, dim int, value double")

    def all_pairs(power):
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
        out = []
        for i in range(60):
            own = lab == lab[i]
            if own.sum() == 1:
                out.append(0.0)
                continue
            a = dist[i][own].sum() / (own.sum() - 1)
            b = min(dist[i][lab == c].mean() for c in set(lab) - {lab[i]})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    assert K.silhouette(df, "id").first()[0] == pytest.approx(all_pairs(2), abs=1e-9)
    full = K.silhouette_sampled(df, "id", 60).first()
    assert full["silhouette"] == pytest.approx(all_pairs(1), abs=1e-9) and (full["n_used"], full["n_points"]) == (60, 60)
    some = K.silhouette_sampled(df, "id", 25).first()
    assert (some["n_used"], some["n_points"]) == (25, 60)


def test_prior_shift_of_exact_zeros_and_ones(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.0, 0.0, 1.0, 0.2, 0.6, None, float("nan")])], "k long, p double")
    out = C.prior_shift(df.where("k < 5"), "p", 0.4, out="q").collect()
    assert np.mean([r["q"] for r in out]) == pytest.approx(0.4, abs=1e-8) and all(0 < r["q"] < 1 for r in out)
    assert C.prior_shift_constant(df, "p", 0.4) == pytest.approx(C.prior_shift_constant(df.where("k < 5"), "p", 0.4))
    for target in (0.0, 1.0, 1.2):
        with pytest.raises(ValueError):
            C.prior_shift_constant(df, "p", target)
    assert C.prior_shift_constant(df.limit(0), "p", 0.4) == 0.0


def test_logit_extrapolate_reports_left_out_points(spark):
    curve = spark.createDataFrame([(2, 0.4), (3, 0.3), (4, 0.0), (5, 1.0), (9, 0.1)], "prior_credits long, rate double")
    r = C.logit_extrapolate(curve).first()
    assert (r["points"], r["points_left_out"]) == (2, 2) and 0 < r["rate_at"] < 1


def test_trees_take_any_number_of_levels(spark):
    df = spark.createDataFrame([(f"c{i % 138}", float(i % 7), float(i % 2), 1.0) for i in range(600)], "cat string, x double, y double, w double")
    for fit in (M.random_forest(["cat"], ["x"], trees=2), M.gbt(["cat"], ["x"], iters=2)):
        assert M.positive_prob(fit(df).transform(df)).where("score BETWEEN 0 AND 1").count() == 600


def test_prior_shift_hits_mean_and_keeps_order(spark):
    rng = np.random.default_rng(1)
    ps = rng.uniform(0.01, 0.99, 400)
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "k long, p double")
    for target in (0.3, 0.85):
        out = C.prior_shift(df, "p", target, out="q").orderBy("p").collect()
        q = [r["q"] for r in out]
        assert np.mean(q) == pytest.approx(target, abs=1e-9)
        assert all(a <= b for a, b in zip(q, q[1:]))


def test_split_keeps_groups_together(spark):
    rows = [(i, "A" if i % 5 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a string, b long").withColumn("gid", S.row_signature(["a", "b"]))
    sp = M.group_split(df, "gid")
    per = sp.groupBy("gid").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    assert per == 0
    # NULL in a different column gives a different signature
    sig = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string").select(S.row_signature(["a", "b"]).alias("g"))
    assert sig.distinct().count() == 2
    folds = M.group_kfold(df.withColumn("y", (F.col("k") % 2).cast("int")), "gid", "y", 5)
    assert folds.groupBy("gid").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_rare_levels(spark):
    train = spark.createDataFrame([("a",)] * 60 + [("b",)] * 3, "c string")
    other = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    out = {r["c"]: r["p"] for r in M.pool_rare(other, M.fit_rare_levels(train, "c", 50), "c", "p").collect()}
    assert out == {"a": "a", "b": "infrequent", "z": None}


def test_sources_and_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="strata-io-")
    csv = os.path.join(d, "b.csv")
    with open(csv, "w") as f:
        f.write("id;Bread;Jam\n1;1;0\n2;1;1\n3;0;0\n")
    wide = tables.scan_delimited(spark, csv, "id long, Bread int, Jam int")
    from strata.operators import baskets as B
    lng = B.basket_long(wide, "id", ["Bread", "Jam"])
    assert sorted((r["basket_id"], r["item"]) for r in lng.collect()) == [(1, "Bread"), (2, "Bread"), (2, "Jam")]
    p = sinks.sink_table(lng, os.path.join(d, "stage"))
    assert tables.scan_stage(spark, p).count() == 3
    one = lng.agg(F.count(F.lit(1)).alias("n"))
    sinks.sink_summary(one, os.path.join(d, "summary"))
    assert tables.scan_json(spark, os.path.join(d, "summary"), multiline=False).first()["n"] == 3
    man = sinks.sink_bundle(spark, {"long": lng, "one": one}, os.path.join(d, "bundle"))
    assert {r["name"]: r["rows"] for r in man.collect()} == {"long": 3, "one": 1}
    payload = sinks.nested_payload({"counts": lng.groupBy("item").count()}).first()["payload"]
    assert sorted(x["item"] for x in json.loads(payload)["counts"]) == ["Bread", "Jam"]
    bad = spark.createDataFrame([(float("nan"),)], "v double")
    with pytest.raises(Exception):
        sinks.nested_payload({"bad": bad}).collect()


def test_format_cells(spark):
    df = spark.createDataFrame([(0.1234, 1234567.8)], "p double, v double")
    r = df.select(S.format_pct("p").alias("a"), S.format_thousands("v").alias("b")).first()
    assert (r["a"], r["b"]) == ("12.3%", "1,234,568")


def test_tree_attribution_is_additive(spark):
    from pyspark.ml.functions import vector_to_array
    from strata.operators import attribution as I
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a, b = float(rng.normal()), float(rng.normal())
        cat = ["u", "v", "w"][i % 3]
        rows.append((i, a, b, cat, int(a + 0.5 * b + (cat == "u") + rng.normal(scale=0.3) > 0.5)))
    df = spark.createDataFrame(rows, "k long, a double, b double, c string, y int")
    m = M.gbt(["c"], ["a", "b"], iters=5, depth=3)(df)
    contrib = I.tree_attribution(m, df, "k")
    tot = contrib.groupBy("k").agg((F.sum("contribution") + F.first("base")).alias("m"))
    raw = m.transform(df).select("k", vector_to_array("rawPrediction")[1].alias("margin"))
    diff = tot.join(raw, "k").select(F.max(F.abs(F.col("m") - F.col("margin")))).first()[0]
    assert diff < 1e-9


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), int(rng.random() < x)) for x in rng.uniform(0, 1, 400)]
    df = spark.createDataFrame(rows, "raw double, y int")
    out = M.apply_isotonic(M.fit_isotonic(df, "raw", "y"), df).orderBy("raw").collect()
    cal = [r["calibrated"] for r in out]
    assert all(a <= b + 1e-12 for a, b in zip(cal, cal[1:]))
    assert 0.0 <= min(cal) and max(cal) <= 1.0


def test_rule_collapse_is_order_free(spark):
    from strata.operators import baskets as B
    rows = []
    for b in range(400):
        items = ["a", "b", "c", "d"][: 2 + b % 3] if b % 2 == 0 else ["c", "d", "e"][: 1 + b % 3]
        rows += [(b, it) for it in items]
    df = spark.createDataFrame(rows, "basket_id long, item string")
    def run(d):
        fi = B.frequent_itemsets(d, 0.05, 5)
        kept = B.rule_collapse(B.rule_filter(B.association_rules(fi, 1.0), lift_min=1.0, n_min=10, conf_factor=1.0))
        return sorted((tuple(r["items"]), round(r["lift"], 12)) for r in kept.collect())
    assert run(df) == run(df.orderBy(F.desc("basket_id")).repartition(7))


def test_fit_passes_have_tasks_by_rows(spark, monkeypatch):
    """A model fit reads its rows in as many parts as they are worth, however many the plan before ended with."""
    from strata import session

    rows = spark.range(300).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 7 > 3 AS INT) AS y")
    cores, seen = spark.sparkContext.defaultParallelism, []
    many = session.materialize(rows.repartition(60))
    few = session.gathered(many)
    assert few.rdd.getNumPartitions() == 2 * cores and sorted(r["id"] for r in few.collect()) == list(range(300))
    monkeypatch.setattr(M, "missing_stage", lambda train, nums, f=M.missing_stage: seen.append(train.rdd.getNumPartitions()) or f(train, nums))
    model = M.gbt([], ["x"], iters=2, depth=2)(many)
    assert seen == [2 * cores] and model.transform(many).where("prediction <> y").count() == 0
    small = session.materialize(rows.repartition(3))
    assert session.gathered(small) is small      # parts and order of a small frame stay
    monkeypatch.setattr(session, "FIT_ROWS", 10)
    dealt = session.gathered(small)
    assert dealt.rdd.getNumPartitions() == 30 and sorted(r["id"] for r in dealt.collect()) == list(range(300))


def test_stored_portfolio_is_worked_out_once(spark):
    """Queries that read the portfolio many times read stored rows, not the scans and joins again."""
    from strata.plans.q_models import modelable
    from strata.sources.fixtures import Fixtures

    fx, scans = Fixtures(spark, "/root/testdata/sf0.001"), []
    scan = Fixtures.t
    want = sorted(map(tuple, fx.portfolio.collect()))
    try:
        Fixtures.t = lambda self, name, *cols: scans.append(name) or scan(self, name, *cols)
        stored = Fixtures(spark, fx.base).stored()
        assert sorted(map(tuple, stored.portfolio.collect())) == want and scans.count("orders") == 1
        assert not any("orders" in f for f in [*stored.portfolio.inputFiles(), *stored.portfolio_base.inputFiles(), *stored.portfolio_active.inputFiles()])
    finally:
        Fixtures.t = scan
    narrow = "client_id", "gid", "split"
    assert sorted(map(tuple, modelable(fx, True).select(*narrow).collect())) == sorted(map(tuple, modelable(fx).select(*narrow).collect()))
