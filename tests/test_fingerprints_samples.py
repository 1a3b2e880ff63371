"""Table fingerprints and deliveries, samples by threshold, shifts to many targets, silhouette in blocks."""

import hashlib
import io
import os
from collections import Counter
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import campaign as C
from strata.operators import fingerprint as FP
from strata.operators import order as O
from strata.operators import relational as R
from strata.operators import segments as K
from strata.sources import sinks


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k long, v double, s string")


BASE = [(1, 1.0, "a"), (1, 1.0, "a"), (2, None, "b"), (None, 2.0, None), (3, float("nan"), "")]


def test_fingerprint_ignores_order_and_sees_every_change(spark):
    mark = FP.fingerprint(_rows(spark, BASE)).first()
    assert mark["rows"] == 5
    assert FP.fingerprint(_rows(spark, BASE[::-1]).repartition(3)).first() == mark
    changed = [BASE[1:], BASE + BASE[:1], [(2, 1.0, "a")] + BASE[1:], BASE[:2] + [(None, 2.0, "b")] + BASE[3:], BASE[:4] + [(3, float("nan"), None)]]
    marks = {FP.fingerprint(_rows(spark, rows)).first()["checksum"] for rows in changed}
    assert len(marks) == len(changed) and mark["checksum"] not in marks
    none = FP.fingerprint(_rows(spark, [])).first()
    assert (none["rows"], none["checksum"]) == (0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_differing_rows_are_the_multiset_difference(spark, buckets):
    rng = np.random.default_rng(7)
    pick = lambda n: [(int(k), float(v) if v else None, "x" * int(k % 3)) for k, v in rng.integers(0, 12, (n, 2))]
    a, b = pick(200), pick(180)
    want = Counter(a)
    want.subtract(Counter(b))
    got = FP.differing_rows(_rows(spark, a), _rows(spark, b).toDF("q", "r", "t"), buckets).collect()
    assert {(r["k"], r["v"], r["s"]): r["_n"] for r in got} == {row: n for row, n in want.items() if n}
    t = R.tables_equal(_rows(spark, a), _rows(spark, b)).first()
    assert (t["only_a"], t["only_b"], t["equal"]) == (sum(n for n in want.values() if n > 0), -sum(n for n in want.values() if n < 0), False)


def test_equal_tables_shuffle_bucket_sums_only(spark, tmp_path):
    """The rows' only way to an exchange is behind the semi join with the buckets that differ."""
    t = R.tables_equal(_rows(spark, BASE), _rows(spark, BASE[::-1])).first()
    assert tuple(t) == (0, 0, True)
    assert tuple(R.tables_equal(_rows(spark, []), _rows(spark, [])).first()) == (0, 0, True)
    spark.range(50_000).select("id", (F.col("id") % 7).alias("g")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    buf = io.StringIO()
    with redirect_stdout(buf):
        FP.differing_rows(df, df).explain("simple")
    plan = buf.getvalue()
    assert "BroadcastHashJoin [_bucket" in plan and "LeftSemi" in plan and "except" not in plan.lower()
    with pytest.raises(ValueError):
        R.tables_equal(df, df.withColumn("g", F.col("g").cast("string")))


def test_torn_delivery_is_found(spark, tmp_path):
    base = str(tmp_path / "bundle")
    a, b = spark.range(100).withColumn("v", F.col("id") * 2), spark.range(5)
    sinks.sink_bundle(spark, {"a": a, "b": b}, base)
    assert all(r["intact"] for r in sinks.verify_bundle(spark, base).collect())
    b.withColumn("id", F.when(F.col("id") == 3, 30).otherwise(F.col("id"))).write.mode("overwrite").parquet(f"{base}/b")
    assert {r["name"]: r["intact"] for r in sinks.verify_bundle(spark, base).collect()} == {"a": True, "b": False}
    a.limit(0).write.mode("overwrite").parquet(f"{base}/a")
    found = {r["name"]: (r["rows"], r["rows_found"], r["intact"]) for r in sinks.verify_bundle(spark, base).collect()}
    assert found["a"] == (100, 0, False)
    for f in os.listdir(f"{base}/a"):
        os.remove(f"{base}/a/{f}")
    assert not {r["name"]: r["intact"] for r in sinks.verify_bundle(spark, base).collect()}["a"]
    # a second delivery that stops in its second table leaves no valid manifest
    with pytest.raises(Exception):
        sinks.sink_bundle(spark, {"a": a, "b": b.select(F.raise_error(F.lit("stop")).alias("x"))}, base)
    with pytest.raises(ValueError):
        sinks.verify_bundle(spark, base)
    csv = str(tmp_path / "csv")
    sinks.sink_bundle(spark, {"a": a}, csv, fmt="csv")
    assert sinks.verify_bundle(spark, csv).first()["intact"]


@pytest.mark.parametrize("n", [0, 1, 17, 1000, 2999, 3000, 5000])
def test_sample_by_threshold_is_bottom_n(spark, n):
    df = spark.range(3000).withColumnRenamed("id", "k").withColumn("v", F.col("k") % 5)
    want = sorted(range(3000), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())[:n]
    for rows in (1, 100_000):
        got = R.sample_seeded(df, "k", n, cut_rows=rows)
        assert got.columns == df.columns and sorted(r["k"] for r in got.collect()) == sorted(want)


def test_sample_of_a_hot_key(spark):
    """2,000 rows share one key: their order is by the whole row, in any partitioning; equal rows are taken in any number."""
    df = spark.range(2000).select(F.lit(1).alias("k"), (F.col("id") % 500).alias("v"), F.lit(None).cast("string").alias("s"))
    a = sorted(tuple(r) for r in R.sample_seeded(df, "k", 777, cut_rows=1).collect())
    b = sorted(tuple(r) for r in R.sample_seeded(df.repartition(7), "k", 777, cut_rows=50).collect())
    assert len(a) == 777 and a == b
    assert R.sample_seeded(df.limit(0), "k", 5).count() == 0


def test_large_sample_has_no_single_task_top_n(spark):
    df = spark.range(200_000).withColumnRenamed("id", "k")
    got = R.sample_seeded(df, "k", 70_000, cut_rows=1000)
    assert got.count() == 70_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(part.split()[0].rstrip(")")) for part in plan.split("GlobalLimit ")[1:]]
    assert limits and max(limits) <= 1000


def _expit(z):
    return 1 / (1 + np.exp(-z))


def test_many_targets_share_the_passes(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1, 400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(900, None), (901, float("nan"))], "k long, p double")
    targets = [0.02, 0.3, 0.5, 0.77, 0.99]
    cs = C.prior_shift_constants(df, "p", targets)
    z = np.log(p / (1 - p))
    for t, c in zip(targets, cs, strict=True):
        assert _expit(z + c).mean() == pytest.approx(t, abs=1e-9)
    assert C.prior_shift_constants(df, "p", []) == []
    out = {r["k"]: r["q"] for r in C.prior_shift(df, "p", 0.3, out="q").collect()}
    assert out[900] is None and out[901] is None and out[0] == pytest.approx(_expit(z[0] + cs[1]))


def test_sensitivity_equals_separate_shifts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, round(float(x), 2), bool(s)) for i, (x, s) in enumerate(zip(rng.uniform(0.01, 0.99, 300), rng.integers(0, 2, 300), strict=True))]
    rows += [(1000, None, True), (1001, float("nan"), False), (1002, 0.0, True), (1003, 1.0, True), (1004, 1.0, False)]
    df = spark.createDataFrame(rows, "k long, p double, seg boolean")
    got = {r["target"]: r for r in C.prior_sensitivity(df, "p", "k", F.col("seg"), [0.2, 0.8], [10, 60, 1000]).collect()}
    for t in (0.2, 0.8):
        sh = C.prior_shift(df, "p", t, out="pp", where=F.col("seg"))
        rk = O.global_rank(sh, "pp", "k", out="rk").collect()
        have = [r["pp"] for r in rk if r["pp"] is not None and not np.isnan(r["pp"])]
        assert got[t]["p_mean"] == pytest.approx(np.mean(have)) and got[t]["expected_losses"] == pytest.approx(np.sum(have))
        for top in (10, 60, 1000):
            assert got[t][f"segment_in_top{top}"] == sum(r["seg"] and r["rk"] <= top for r in rk)


def test_silhouette_over_many_blocks(spark, monkeypatch):
    """500 points in blocks of about 60 against all pairs; a cluster of one point and equal points among them."""
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(500, 4))
    lab = rng.integers(0, 4, 500)
    pts[lab == 1] += 3
    pts[10], lab[10], lab[11] = pts[20], lab[20], 9
    lng = spark.createDataFrame([(i, int(lab[i]), d, float(pts[i, d])) for i in range(500) for d in range(4)], "id long, cluster int, dim int, value double")
    dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    s = []
    for i in range(500):
        own = (lab == lab[i]) & (np.arange(500) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = dist[i][own].mean(), min(dist[i][lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    monkeypatch.setattr(K, "BLOCK_POINTS", 60)
    got = K.silhouette_sampled(lng, "id", 500)
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    one = got.first()
    assert one["silhouette"] == pytest.approx(np.mean(s), abs=1e-9) and (one["n_used"], one["n_points"]) == (500, 500)
