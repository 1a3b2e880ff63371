"""Quantiles by refinement and length-bounded itemset mining, against brute force and by plan."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from strata.operators import baskets as B
from strata.operators import order as O
from strata.plans import q_baskets
from strata.sources.fixtures import Fixtures
from tests.conftest import SMOKE

QS = [0, 0.01, 0.25, 0.5, 0.75, 0.9, 1]


@pytest.fixture(scope="module")
def values(spark):
    rnd = np.random.default_rng(1)
    rows = [(("a", "b", None)[i % 3] if i % 10 else "c", float(rnd.choice([rnd.normal(), 1.0, 2.5]))) for i in range(3000)]
    odd = [("a", None), ("b", float("nan")), ("tiny", 3.0), (None, -0.5)]
    return rows + odd, spark.createDataFrame(rows + odd, "g string, v double").repartition(6)


@pytest.mark.parametrize("accuracy,window", [(10_000, 2_000_000), (20, 2_000_000), (20, 0)])
def test_quantiles_equal_numpy(values, monkeypatch, accuracy, window):
    """Also with a sketch so coarse that brackets overlap or miss, and without the window over the small table."""
    monkeypatch.setattr(O, "WINDOW_ROWS", window)
    rows, df = values
    own = {}
    for g, v in rows:
        if v is not None and v == v:
            own.setdefault(g, []).append(v)
    got = {(r["g"], r["q"]): r["value"] for r in O.exact_quantiles(df, "v", QS, by=["g"], accuracy=accuracy).collect()}
    assert got == {(g, q): pytest.approx(np.quantile(x, q), abs=1e-12) for g, x in own.items() for q in QS}
    every = [v for x in own.values() for v in x]
    got = {r["q"]: r["value"] for r in O.exact_quantiles(df, "v", QS, accuracy=accuracy).collect()}
    assert got == {q: pytest.approx(np.quantile(every, q), abs=1e-12) for q in QS}


def test_brackets_that_miss_are_widened(values, monkeypatch):
    rows, df = values
    asked, real = [], O._brackets

    def narrow(g, by, qs, accuracy, margin):
        asked.append(margin)
        from pyspark.sql import functions as F
        return real(g, by, qs, accuracy, margin) if margin > 2 else \
            g.agg(F.count("*").alias("_N"), F.array(F.struct(F.lit(9.0).alias("lo"), F.lit(9.5).alias("hi"))).alias("_br"))

    monkeypatch.setattr(O, "_brackets", narrow)
    got = O.exact_quantiles(df, "v", [0.5]).first()["value"]
    assert len(asked) > 1 and got == pytest.approx(np.median([v for _, v in rows if v is not None and v == v]))


def test_quantiles_without_rows(values):
    assert O.exact_quantiles(values[1].where("g = 'none'"), "v", [0.5]).collect() == []
    assert O.exact_quantiles(values[1].where("g = 'none'"), "v", [0.5], by=["g"]).collect() == []


def test_few_values_are_shuffled(spark):
    """Of 200,000 distinct values only those near the targets become rows of the counted table."""
    df = spark.range(200_000).selectExpr("cast(id as double) AS _v")
    small = O.compressed_counts(df, [], O._brackets(df, [], [0.25, 0.5], 10_000, 2))
    assert small.count() < 1_000 and small.agg({"n": "sum"}).first()[0] == 200_000


def brute_sets(rows, support, most):
    held = {}
    for b, i in rows:
        held.setdefault(b, set()).update([i] if i else [])
    found = Counter(x for v in held.values() for k in range(1, most + 1) for x in itertools.combinations(sorted(v), k))
    return {k: (n, len(k)) for k, n in found.items() if n >= support * len(held)}


def test_a_planted_basket_of_thirty_items(spark):
    rnd = random.Random(2)
    rows = [(b, f"p{i:02d}") for b in range(200) for i in range(30)] + [(1000 + b, rnd.choice("abcdefgh")) for b in range(300) for _ in range(4)]
    rows += [(5000, None), (None, "a"), (None, "b")]
    got = B.frequent_itemsets(spark.createDataFrame(rows, "basket_id long, item string"), 0.05, 3).collect()
    assert {tuple(r["items"]): (r["n"], r["size"]) for r in got} == brute_sets(rows, 0.05, 3)


def test_ranges_of_baskets_add_up(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(b, f"i{min(rnd.randrange(9), rnd.randrange(9))}") for b in range(700) for _ in range(rnd.randint(1, 5))]
    df = spark.createDataFrame(rows, "basket_id long, item string").repartition(5)
    got = {tuple(r["items"]): (r["n"], r["size"]) for r in B.frequent_itemsets(df, 0.02, 4).collect()}
    assert got == brute_sets(rows, 0.02, 4)
    assert B.frequent_itemsets(df.limit(0), 0.02, 4).collect() == []


def test_itemsets_are_mined_once(spark, monkeypatch):
    calls, real = [], B.frequent_itemsets
    monkeypatch.setattr(B, "frequent_itemsets", lambda *a, **k: calls.append(1) or real(*a, **k))
    df = q_baskets.same_basket_rules(Fixtures(spark, SMOKE))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(calls) == 1 and "FileScan" not in plan and "Scan ExistingRDD" in plan
