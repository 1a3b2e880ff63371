"""PSI edge cases, KS, baskets (planted sets, collapse), components, join guard."""

import pytest
from pyspark.sql import functions as F

from strata.operators import audit as A
from strata.operators import baskets as B
from strata.operators import relational as R


def test_psi_same_table_is_zero(spark):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)], "x double")
    assert A.psi_quantile(df, df, ["x"]).first()["psi"] == pytest.approx(0.0, abs=1e-12)


def test_psi_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0,)] * 50, "x double")
    assert A.psi_quantile(df, df, ["x"]).first()["psi"] is None


def test_psi_disjoint_uses_floor(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    b = spark.createDataFrame([(1000.0 + i,) for i in range(100)], "x double")
    psi = A.psi_quantile(a, b, ["x"]).first()["psi"]
    assert psi > 5


def test_psi_fixed_drops_zero_from_first_bin(spark):
    a = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "x double")
    t = A.psi_fixed(a, a, "x", [0, 1, 3]).orderBy("bin").collect()
    assert [r["hist"] for r in t] == [0.5, 0.5]
    assert t[0]["psi"] == pytest.approx(0.0)


def test_ks_two_sample(spark):
    a = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    b = spark.createDataFrame([(float(i) + 5,) for i in range(10)], "v double")
    assert A.ks_two_sample(a, b, "v").first()["ks"] == pytest.approx(0.5)


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    bid = 0
    for i in range(300):             # planted 4-item set
        for it in ["a", "b", "c", "d"]:
            rows.append((bid, it))
        bid += 1
    for i in range(700):             # noise
        for it in [["e"], ["a", "e"], ["f", "b"], ["c"], ["d", "f"], ["e", "f"], ["a"]][i % 7]:
            rows.append((bid, it))
        bid += 1
    return spark.createDataFrame(rows, "basket_id long, item string")


def test_rules_all_splits_and_collapse(planted):
    fi = B.frequent_itemsets(planted, 0.05, 5)
    four = fi.where(F.size("items") == 4).collect()
    assert len(four) == 1 and four[0]["n"] == 300
    rules = B.association_rules(fi, 1.0)
    # every split of {a,b,c,d}: 2^4 - 2 = 14 rules, multi-item consequents included
    r4 = rules.where(F.size("items") == 4)
    assert r4.count() == 14
    assert r4.where(F.size("consequent") >= 2).count() > 0
    # confidence 1 → conviction NULL
    assert rules.where((F.col("confidence") >= 1) & F.col("conviction").isNotNull()).count() == 0
    kept = B.rule_collapse(B.rule_filter(rules, lift_min=1.0, n_min=100, conf_factor=1.0))
    sets = [tuple(r["items"]) for r in kept.collect()]
    # no retained itemset is strictly inside another retained one with lift >=
    lifts = {tuple(r["items"]): r["lift"] for r in kept.collect()}
    for s in sets:
        for t in sets:
            if s != t and set(s) < set(t):
                assert lifts[t] < lifts[s]


def test_components(spark):
    chain = [(f"n{i}", f"n{i + 1}", 1.0) for i in range(9)]
    island = [("x", "y", 1.0), ("p", "q", 1.0), ("q", "r", 1.0), ("r", "p", 1.0)]
    e = spark.createDataFrame(chain + island, "src string, dst string, weight double")
    c = B.components(e)
    sizes = sorted({(r["component"], r["size"]) for r in c.collect()}, key=lambda t: t[1])
    assert [s for _, s in sizes] == [2, 3, 10]


def test_components_of_a_long_chain(spark):
    n = 400
    order = [(i * 131) % n for i in range(n)]           # neighbours far apart in label order
    e = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in zip(order, order[1:])], "src string, dst string")
    got = B.components(e).collect()
    assert len(got) == n and {(r["component"], r["size"]) for r in got} == {("n000", n)}


def test_join_guard_fails_on_duplicate_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        R.left_join_checked(left, right, ["k"])


def test_dedupe_and_tables_equal(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0)], "k int, v double")
    d = R.dedupe_best(df, ["k"], [F.col("v").desc()])
    assert sorted((r["k"], r["v"]) for r in d.collect()) == [(1, 7.0), (2, 1.0)]
    t = R.tables_equal(df, df).first()
    assert t["equal"]


def test_schema_diff_and_bootstrap(spark):
    a = spark.createDataFrame([(1, 2.0)], "k long, v double")
    b = spark.createDataFrame([(1, "x")], "k long, w string")
    d = [(r["column"], r["only_in"]) for r in R.schema_diff(a, b).collect()]
    assert d == [("v", "a"), ("w", "b")]
    base = spark.range(2000)
    s1 = R.sample_bootstrap(base, seed=5)
    s2 = R.sample_bootstrap(base, seed=5)
    assert sorted(r["id"] for r in s1.collect()) == sorted(r["id"] for r in s2.collect())
    assert 1700 < s1.count() < 2300
    n = R.sample_seeded(base.withColumnRenamed("id", "k"), "k", 50).count()
    assert n == 50


def test_subset_pairs(spark):
    rows = [(["a", "b"], 1.5), (["a", "b", "c"], 1.6), (["a", "c"], 2.0), (["b"], 1.0)]
    df = spark.createDataFrame(rows, "items array<string>, lift double")
    got = sorted((tuple(r["inner"]), tuple(r["outer"])) for r in B.subset_pairs(df).collect())
    assert got == [(("a", "b"), ("a", "b", "c")), (("b",), ("a", "b")), (("b",), ("a", "b", "c"))]


def test_join_guard_fails_on_missing_required_value(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception):
        R.left_join_checked(left, right, ["k"], not_null=["v"]).collect()
    ok = R.left_join_checked(left, right, ["k"]).collect()
    assert len(ok) == 2
