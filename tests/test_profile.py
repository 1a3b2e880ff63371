"""Stored profiles equal the operators on rows; column dictionary exact and by sketch; bounded level lists."""

import io
import math
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import audit as A
from strata.operators import profile as P

NUMS, CATS = ["a", "b", "flat", "none"], ["c", "d"]
SCHEMA = "a double, b long, flat double, none double, c string, d int"


def _pop(spark, seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [(None if i % 17 == 0 else float(rng.normal(shift)), int(rng.integers(0, 6)), 1.0, None,
             None if i % 11 == 0 else f"l{int(rng.integers(0, 5 + 3 * shift))}", int(rng.integers(0, 4))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _by(df):
    return {r["variable"]: r.asDict() for r in df.collect()}


def _same(x, y):
    assert x.keys() == y.keys()
    for v in x:
        assert x[v].keys() == y[v].keys()
        for c in x[v]:
            assert x[v][c] == (pytest.approx(y[v][c], abs=1e-9) if isinstance(y[v][c], float) else y[v][c]), (v, c)


def test_profile_equals_rows(spark, tmp_path):
    base, other = _pop(spark, 1, 400), _pop(spark, 2, 300, 1.0)
    path = P.save_profile(P.fit_profile(base, NUMS, CATS), str(tmp_path / "p"))
    stored = P.load_profile(spark, path)
    drift = P.drift_from_profile(stored, other)
    want = A.drift_table(base, other, NUMS)
    _same(_by(drift.select(*want.columns)), _by(want))
    got = _by(drift)
    assert got["flat"]["psi"] is None and got["none"]["psi"] is None and got["a"]["psi"] > 0.5
    psi = _by(A.psi_quantile(base, other, NUMS))
    assert got["b"]["psi"] == pytest.approx(psi["b"]["psi"])
    _same(_by(P.coverage_from_profile(stored, other)), _by(A.coverage(base, other, CATS)))


def test_coverage_against_plain_counts(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), (None, 1)], "c string, d int")
    b = spark.createDataFrame([("x", 2), ("z", 2), (None, 1), ("x", None)], "c string, d int")
    got = _by(A.coverage(a, b, ["c", "d"]))
    assert got["c"] == {"variable": "c", "levels_base": 2, "levels_other": 2, "new_levels": 1, "row_coverage": 0.5}
    assert got["d"] == {"variable": "d", "levels_base": 1, "levels_other": 2, "new_levels": 1, "row_coverage": 0.25}
    assert _by(A.coverage(a, b.limit(0), ["c"]))["c"]["row_coverage"] is None


def test_coverage_joins_levels_not_rows(spark, tmp_path):
    _pop(spark, 3, 50).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    buf = io.StringIO()
    with redirect_stdout(buf):
        A.coverage(t, t, CATS).explain("simple")
    join = buf.getvalue().split("Join", 1)[1]
    assert join.count("HashAggregate") >= 4      # both sides are aggregated below the join


def test_merged_profiles_equal_a_profile_of_all_rows(spark):
    one, two = _pop(spark, 4, 300), _pop(spark, 5, 500, 0.4)
    p = P.fit_profile(one, NUMS, CATS)
    m = P.merge_profiles(p, P.count_on(p, two))
    n, want = _by(m.numeric), _by(P.count_on(p, one.unionByName(two)).numeric)
    for v in NUMS:
        for c in ("rows", "n", "low", "high", "edges", "counts"):
            assert n[v][c] == want[v][c], (v, c)
        assert not n[v]["exact"]
    values = np.sort([r["a"] for r in one.unionByName(two).collect() if r["a"] is not None])
    assert abs(np.searchsorted(values, n["a"]["median"]) / len(values) - 0.5) < 0.03
    assert n["none"]["median"] is None
    key = lambda df: {(r["variable"], r["level"]): r["n"] for r in df.collect()}
    assert key(m.levels) == key(P.fit_profile(one.unionByName(two), [], CATS).levels)
    with pytest.raises(Exception, match="different edges"):
        P.merge_profiles(p, P.fit_profile(two, NUMS, CATS)).numeric.collect()


def test_profile_of_an_empty_population(spark):
    p = P.fit_profile(_pop(spark, 1, 10).limit(0), ["a"], CATS)
    row = p.numeric.first()
    assert (row["rows"], row["n"], row["median"], row["edges"]) == (0, 0, None, None) and p.levels.count() == 0
    assert P.drift_from_profile(p, _pop(spark, 1, 20)).first()["psi"] is None
    full = P.fit_profile(_pop(spark, 1, 100), ["a"])
    d = P.drift_from_profile(full, _pop(spark, 1, 10).limit(0)).first()
    assert d["mean_pred"] is None and d["mean_hist"] is not None and math.isfinite(d["psi"])


def test_column_profile_exact_and_by_sketch(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("k"), F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("t"), F.col("id") % 13)).alias("s"),
                                    F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("z"), F.lit(None).cast("int").alias("e"))
    cols = ["k", "s", "z", "e"]
    x = _by(P.column_profile(df, cols))
    assert {c: x[c]["n_distinct"] for c in cols} == {"k": 7000, "s": 13, "z": 1, "e": 0}
    assert {c: x[c]["null_share"] for c in cols} == {"k": 0.0, "s": 0.25, "z": 0.0, "e": 1.0}
    assert (x["k"]["example_num"], x["s"]["example_text"], x["k"]["example_text"]) == (0.0, "t0", None)
    y = _by(P.column_profile(df, cols, lg_sketch=12))
    assert abs(y["k"]["n_distinct"] / 7000 - 1) < 0.06 and y["s"]["n_distinct"] == 13 and y["e"]["n_distinct"] == 0
    assert y["k"]["rows"] == 20_000 and y["s"]["null_share"] == 0.25


def test_level_list_is_bounded(spark):
    df = spark.range(50).select(F.concat(F.lit(" l"), F.col("id") % 20).alias("c"))
    clean = F.trim("c")
    full, cut = P.level_report(df, "c", clean).first(), P.level_report(df, "c", clean, max_levels=3).first()
    assert (full["n_raw"], full["n_clean"], full["more"], len(full["levels"].split(","))) == (20, 20, False, 20)
    assert (cut["levels"], cut["more"]) == ("l0,l1,l10", True)
    none = P.level_report(df.limit(0), "c", clean).first()
    assert (none["n_raw"], none["levels"], none["more"]) == (0, "", False)


def test_level_report_lists_every_level(spark):
    """All levels by default, however many there are, and no column about a cut in the query's SQL."""
    from strata.plans import q_relational as Q

    df = spark.range(1500).select(F.format_string("l%04d", "id").alias("c"))
    row = P.level_report(df, "c", F.trim("c")).first()
    assert row["levels"].split(",") == [f"l{i:04d}" for i in range(1500)] and (row["n_clean"], row["more"]) == (1500, False)
    assert "1000" not in "".join(Q._LQ_PARTS) and " more" not in "".join(Q._LQ_PARTS)
