"""Checked queries for audit and drift operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import audit as A
from ..operators import profile as P
from ..session import scratch_path
from .q_relational import sql_clean
from .registry import query, r

QS11 = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def psi_sql(col: str, ta: str, tb: str) -> str:
    """Scalar subquery: PSI of ``col`` with quantile cuts of ``ta``."""
    return f"""(WITH a AS (SELECT CAST({col} AS DOUBLE) AS v FROM {ta} WHERE {col} IS NOT NULL),
  b AS (SELECT CAST({col} AS DOUBLE) AS v FROM {tb} WHERE {col} IS NOT NULL),
  e AS (SELECT list_sort(list_distinct(quantile_cont(v, {QS11}))) AS e FROM a),
  bins AS (SELECT unnest(range(len(e) - 1)) AS bin FROM e WHERE len(e) >= 3),
  ca AS (SELECT len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x < v)) AS bin, count(*) / (SELECT count(*) FROM a) AS s FROM a, e GROUP BY 1),
  cb AS (SELECT len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x < v)) AS bin, count(*) / (SELECT count(*) FROM b) AS s FROM b, e GROUP BY 1),
  j AS (SELECT CASE WHEN coalesce(ca.s, 0) = 0 THEN 1e-6 ELSE ca.s END AS pa, CASE WHEN coalesce(cb.s, 0) = 0 THEN 1e-6 ELSE cb.s END AS pb
        FROM bins LEFT JOIN ca ON ca.bin = bins.bin LEFT JOIN cb ON cb.bin = bins.bin)
  SELECT CASE WHEN (SELECT len(e) FROM e) < 3 THEN NULL ELSE sum((pa - pb) * ln(pa / pb)) END FROM j)"""


SHIP_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("psi_quantile", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round({psi_sql(c, 'ship_base', 'ship_active')}, 6) AS psi" for c in SHIP_COLS))
def psi_quantile(fx):
    return A.psi_quantile(fx.ship_base, fx.ship_active, SHIP_COLS).select("variable", r("psi").alias("psi"))


DRIFT_COLS = ["nominal_rate", "granted", "balance", "prior_credits", "region", "branch"]


DRIFT_SQL = " UNION ALL ".join(f"""
SELECT '{c}' AS variable,
  (SELECT round(avg({c}), 6) FROM portfolio_base) AS mean_hist, (SELECT round(median(CAST({c} AS DOUBLE)), 6) FROM portfolio_base) AS median_hist,
  (SELECT CAST(min({c}) AS DOUBLE) FROM portfolio_base) AS min_hist, (SELECT CAST(max({c}) AS DOUBLE) FROM portfolio_base) AS max_hist,
  (SELECT round(avg({c}), 6) FROM portfolio_active) AS mean_pred, (SELECT round(median(CAST({c} AS DOUBLE)), 6) FROM portfolio_active) AS median_pred,
  (SELECT CAST(min({c}) AS DOUBLE) FROM portfolio_active) AS min_pred, (SELECT CAST(max({c}) AS DOUBLE) FROM portfolio_active) AS max_pred,
  round({psi_sql(c, 'portfolio_base', 'portfolio_active')}, 6) AS psi""" for c in DRIFT_COLS)


def _drift_columns(d):
    rc = [f"{m}_{p}" for p in ("hist", "pred") for m in ("mean", "median")] + ["psi"]
    return d.select("variable", *[r(c).alias(c) for c in rc], "min_hist", "max_hist", "min_pred", "max_pred")


@query("drift_table", DRIFT_SQL)
def drift_table(fx):
    return _drift_columns(A.drift_table(fx.portfolio_base, fx.portfolio_active, DRIFT_COLS))


def _stored_profile(fx, numeric, categorical):
    path = scratch_path(fx.spark, f"profile-{uuid.uuid4().hex}")
    return P.load_profile(fx.spark, P.save_profile(P.fit_profile(fx.portfolio_base, numeric, categorical), path))


@query("drift_from_profile", DRIFT_SQL)
def drift_from_profile(fx):
    """D1 and D2 against the stored profile of the labelled clients, whose rows are not read again."""
    return _drift_columns(P.drift_from_profile(_stored_profile(fx, DRIFT_COLS, []), fx.portfolio_active))


FIXED_EDGES = [0.0, 1e5, 5e5, 1e6, 2e6, 4e6, float("inf")]


def _fixed_sql():
    e = FIXED_EDGES
    inf = "CAST('inf' AS DOUBLE)"
    case = "CASE " + " ".join(f"WHEN balance > {e[i]} AND balance <= {e[i + 1] if e[i + 1] != float('inf') else inf} THEN {i}"
                              for i in range(len(e) - 1)) + " END"
    return f"""
WITH ha AS (SELECT {case} AS bin FROM portfolio_base), pa AS (SELECT {case} AS bin FROM portfolio_active),
h AS (SELECT bin, count(*) / (SELECT count(bin) FROM ha) AS s FROM ha WHERE bin IS NOT NULL GROUP BY bin),
p AS (SELECT bin, count(*) / (SELECT count(bin) FROM pa) AS s FROM pa WHERE bin IS NOT NULL GROUP BY bin),
j AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(h.s, 0) AS hist, coalesce(p.s, 0) AS pred FROM range({len(e) - 1}) t(i)
      LEFT JOIN h ON h.bin = i LEFT JOIN p ON p.bin = i),
t AS (SELECT sum((CASE WHEN pred = 0 THEN 1e-6 ELSE pred END - CASE WHEN hist = 0 THEN 1e-6 ELSE hist END)
        * ln(CASE WHEN pred = 0 THEN 1e-6 ELSE pred END / CASE WHEN hist = 0 THEN 1e-6 ELSE hist END)) AS psi FROM j)
SELECT bin, round(hist, 6) AS hist, round(pred, 6) AS pred, round(pred - hist, 6) AS dif, round(psi, 6) AS psi FROM j, t"""


@query("psi_fixed", _fixed_sql())
def psi_fixed(fx):
    t = A.psi_fixed(fx.portfolio_base, fx.portfolio_active, "balance", FIXED_EDGES)
    return t.select("bin", *[r(c).alias(c) for c in ["hist", "pred", "dif", "psi"]])


@query("extreme_share", """
SELECT 'base' AS scope, round(avg(CAST(balance = 0 AS INTEGER)), 6) AS share_zero_balance, round(avg(CAST(granted <= 500000 AS INTEGER)), 6) AS share_small_granted FROM portfolio_base
UNION ALL SELECT 'active', round(avg(CAST(balance = 0 AS INTEGER)), 6), round(avg(CAST(granted <= 500000 AS INTEGER)), 6) FROM portfolio_active
UNION ALL SELECT 'status=' || status, round(avg(CAST(balance = 0 AS INTEGER)), 6), round(avg(CAST(granted <= 500000 AS INTEGER)), 6) FROM portfolio_base GROUP BY status""")
def extreme_share(fx):
    def agg(df):
        return [r(F.avg((F.col("balance") == 0).cast("int"))).alias("share_zero_balance"),
                r(F.avg((F.col("granted") <= 500000).cast("int"))).alias("share_small_granted")]
    a = fx.portfolio_base.agg(F.lit("base").alias("scope"), *agg(None))
    b = fx.portfolio_active.agg(F.lit("active").alias("scope"), *agg(None))
    c = fx.portfolio_base.groupBy(F.concat(F.lit("status="), F.col("status")).alias("scope")).agg(*agg(None))
    return a.unionByName(b).unionByName(c)


RATIO_SQL = "balance / granted"


def ks_sql(ta: str, tb: str, name: str) -> str:
    return f"""SELECT '{name}' AS comparison, (WITH u AS (SELECT {RATIO_SQL} AS v, 1 AS fa FROM {ta} UNION ALL SELECT {RATIO_SQL}, 0 FROM {tb}),
  s AS (SELECT v, sum(fa) AS na, sum(1 - fa) AS nb FROM u GROUP BY v),
  c AS (SELECT sum(na) OVER (ORDER BY v) / (SELECT sum(na) FROM s) AS ca, sum(nb) OVER (ORDER BY v) / (SELECT sum(nb) FROM s) AS cb FROM s)
  SELECT round(max(abs(ca - cb)), 6) FROM c) AS ks"""


@query("ks_two_sample", " UNION ALL ".join([
    ks_sql("portfolio_active", "portfolio_base", "all"),
    ks_sql("portfolio_active", "(SELECT * FROM portfolio_base WHERE y = 0)", "renewed"),
    ks_sql("portfolio_active", "(SELECT * FROM portfolio_base WHERE y = 1)", "retired")]))
def ks_two_sample(fx):
    ratio = F.try_divide(F.col("balance"), F.col("granted")).alias("ratio")
    act = fx.portfolio_active.select(ratio)
    base = fx.portfolio_base.select(ratio, "y")
    a = (act.withColumn("comparison", F.lit("all")).unionByName(act.withColumn("comparison", F.lit("renewed")))
         .unionByName(act.withColumn("comparison", F.lit("retired"))))
    b = (base.withColumn("comparison", F.lit("all"))
         .unionByName(base.where("y = 0").withColumn("comparison", F.lit("renewed")))
         .unionByName(base.where("y = 1").withColumn("comparison", F.lit("retired")))).drop("y")
    return A.ks_two_sample(a, b, "ratio", by=["comparison"]).select("comparison", r("ks").alias("ks"))


AUC_COLS = ["nominal_rate", "granted", "balance", "prior_credits", "region", "branch", "acctbal"]


def auc_sql(score_expr: str, source: str) -> str:
    return f"""(WITH d AS (SELECT {score_expr} AS s, y FROM {source}),
  g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY s),
  c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
  SELECT sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM c)"""


@query("univariate_auc", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, round(greatest(a, 1 - a), 6) AS auc, CASE WHEN a > 0.5 THEN '+' ELSE '-' END AS direction
FROM (SELECT {auc_sql(f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM portfolio))", "portfolio")} AS a)"""
                                         for c in AUC_COLS))
def univariate_auc(fx):
    return A.univariate_auc(fx.portfolio, AUC_COLS, "y").select("variable", r("auc").alias("auc"), "direction")


CAT_SQL = {"credit_type": sql_clean("credit_type", None), "sex": sql_clean("sex"), "stage": "stage"}


@query("target_rate_auc", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, round(greatest(a, 1 - a), 6) AS auc, 'cat' AS direction
FROM (SELECT {auc_sql("avg(CAST(y AS DOUBLE)) OVER (PARTITION BY lvl)", f"(SELECT {e} AS lvl, y FROM portfolio)")} AS a)"""
                                           for c, e in CAT_SQL.items()))
def target_rate_auc(fx):
    d = fx.portfolio.select("y", S.clean_category("credit_type", None).alias("credit_type"),
                            S.clean_category("sex").alias("sex"), "stage")
    return A.target_rate_auc(d, list(CAT_SQL), "y").select("variable", r("auc").alias("auc"), "direction")


@query("range_leak", """
WITH g AS (SELECT y, count(*) AS n, min(client_id) AS min_key, max(client_id) AS max_key FROM portfolio GROUP BY y),
c AS (SELECT max(client_id) FILTER (WHERE y = 1) AS cut, min(client_id) FILTER (WHERE y = 0) AS m0 FROM portfolio),
a AS (SELECT round(avg(CAST(CAST(client_id <= cut AS INTEGER) = y AS DOUBLE)), 6) AS rule_accuracy FROM portfolio, c)
SELECT y, n, min_key, max_key, cut, cut < m0 AS disjoint, rule_accuracy FROM g, c, a""")
def range_leak(fx):
    return A.range_leak(fx.portfolio, "client_id", "y").withColumn("rule_accuracy", r("rule_accuracy"))


@query("deterministic_level", """
SELECT CAST(prior_credits = 1 AS INTEGER) AS first_credit, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate,
  (SELECT round(avg(CAST(prior_credits = 1 AS INTEGER)), 6) FROM portfolio_active) AS share_active
FROM portfolio_base GROUP BY 1""")
def deterministic_level(fx):
    share = fx.portfolio_active.agg(r(F.avg((F.col("prior_credits") == 1).cast("int"))).alias("share_active"))
    g = fx.portfolio_base.groupBy((F.col("prior_credits") == 1).cast("int").alias("first_credit")) \
        .agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate"))
    return g.crossJoin(share)


CONFLICT_FEATS = ["product", "stage", "sex", "region", "prior_credits"]


@query("conflict_groups", f"""
SELECT count(*) AS n_groups, count(*) FILTER (WHERE k > 1) AS n_conflict
FROM (SELECT count(DISTINCT status) AS k FROM portfolio GROUP BY {', '.join(CONFLICT_FEATS)})""")
def conflict_groups(fx):
    return A.conflict_groups(fx.portfolio, CONFLICT_FEATS, "status")


RATIO_EDGES = [-0.001, 0.1, 0.2, 0.4, 0.6, float("inf")]
RATIO_LABELS = ["<0.10", "0.10-0.20", "0.20-0.40", "0.40-0.60", ">0.60"]
K_EDGES = [1, 2, 3, 5, 8, float("inf")]
K_LABELS = ["2", "3", "4-5", "6-8", "9+"]


def _case(x, edges, labels):
    parts = []
    for i, lab in enumerate(labels):
        hi = edges[i + 1]
        hi_s = "CAST('inf' AS DOUBLE)" if hi == float("inf") else str(hi)
        parts.append(f"WHEN {x} > {edges[i]} AND {x} <= {hi_s} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@query("rate_by_bin", f"""
SELECT {_case('balance / granted', RATIO_EDGES, RATIO_LABELS)} AS ratio_bin, {_case('prior_credits', K_EDGES, K_LABELS)} AS credit_bin,
  count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate
FROM portfolio WHERE prior_credits >= 2 GROUP BY 1, 2""")
def rate_by_bin(fx):
    d = fx.portfolio.where("prior_credits >= 2")
    return (d.groupBy(S.cut_bins(F.try_divide(F.col("balance"), F.col("granted")), RATIO_EDGES, RATIO_LABELS).alias("ratio_bin"),
                      S.cut_bins("prior_credits", K_EDGES, K_LABELS).alias("credit_bin"))
            .agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate")))


COV_COLS = ["product", "region", "branch", "stage", "prior_credits"]


COVERAGE_SQL = " UNION ALL ".join(f"""
SELECT '{c}' AS variable, (SELECT count(DISTINCT {c}) FROM portfolio_base) AS levels_base,
  (SELECT count(DISTINCT {c}) FROM portfolio_active) AS levels_other,
  (SELECT count(*) FROM (SELECT DISTINCT {c} FROM portfolio_active WHERE {c} IS NOT NULL EXCEPT SELECT DISTINCT {c} FROM portfolio_base)) AS new_levels,
  (SELECT round(avg(CASE WHEN {c} IN (SELECT {c} FROM portfolio_base WHERE {c} IS NOT NULL) THEN 1.0 ELSE 0.0 END), 6) FROM portfolio_active) AS row_coverage"""
                                    for c in COV_COLS)


def _coverage_columns(c):
    return c.select("variable", "levels_base", "levels_other", "new_levels", r("row_coverage").alias("row_coverage"))


@query("coverage", COVERAGE_SQL)
def coverage(fx):
    return _coverage_columns(A.coverage(fx.portfolio_base, fx.portfolio_active, COV_COLS))


@query("coverage_from_profile", COVERAGE_SQL)
def coverage_from_profile(fx):
    """D12 against the levels of a stored profile."""
    return _coverage_columns(P.coverage_from_profile(_stored_profile(fx, [], COV_COLS), fx.portfolio_active))
