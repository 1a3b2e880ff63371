"""Checked queries for risk, campaign and scenario operators (C*) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FE
from ..operators import campaign as C
from ..operators import order as O
from .q_order import DEC_SQL
from .registry import query, r

# parameters of the synthetic portfolio (amounts are TPC-H order totals, so the contact
# cost is scaled to them; margin and effectiveness are the reference's values)
CFG = C.Campaign(margin=0.30, contact_cost=5000.0, effectiveness=0.20)
EFFS = [0.10, 0.20, 0.30]
CAPS = [50, 100, 150, 200, 300]
GRID_COSTS = [2500.0, 5000.0, 10000.0]
GRID_CAPS = [100, 300, 1000]

VALUE_SQL = "granted * nominal_rate / 100.0 * 0.3"
BENEFIT_SQL = f"p * 0.2 * ({VALUE_SQL}) - 5000.0"
SEG_SQL = "CASE WHEN p > -0.01 AND p <= 0.2 THEN 'Low' WHEN p > 0.2 AND p <= 0.5 THEN 'Medium' WHEN p > 0.5 AND p <= 1.01 THEN 'High' END"


def valued(fx):
    return C.expected_value(fx.scored, "p", "granted", "nominal_rate", "client_id", CFG)


@query("rate_curve", """
SELECT prior_credits, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM portfolio GROUP BY prior_credits""")
def rate_curve(fx):
    return C.rate_curve(fx.portfolio, "prior_credits", "y").withColumn("rate", r("rate"))


@query("logit_extrapolate", """
WITH c AS (SELECT prior_credits AS k, avg(CAST(y AS DOUBLE)) AS rate FROM portfolio GROUP BY 1),
pts AS (SELECT ln(CAST(k AS DOUBLE)) AS x, ln(rate / (1 - rate)) AS yl FROM c WHERE k BETWEEN 2 AND 5 AND rate > 0 AND rate < 1)
SELECT round(regr_intercept(yl, x), 6) AS a, round(regr_slope(yl, x), 6) AS b, count(*) AS points,
       (SELECT count(*) FROM c WHERE k BETWEEN 2 AND 5 AND NOT (rate > 0 AND rate < 1)) AS points_left_out,
       round(1 / (1 + exp(-(regr_intercept(yl, x) + regr_slope(yl, x) * ln(1.0)))), 6) AS rate_at FROM pts""")
def logit_extrapolate(fx):
    curve = C.rate_curve(fx.portfolio, "prior_credits", "y")
    f = C.logit_extrapolate(curve)
    return f.select(r("a").alias("a"), r("b").alias("b"), "points", "points_left_out", r("rate_at").alias("rate_at"))


def _shift_sql(targets: str) -> str:
    """Bisection of the shift c per target, over the rows of the first segment."""
    return f"""seg AS (SELECT p FROM scored WHERE prior_credits <= 3),
bis(target, step, lo, hi) AS (
  SELECT CAST(target AS DOUBLE), 0, CAST(-30 AS DOUBLE), CAST(30 AS DOUBLE) FROM (VALUES {targets}) AS v(target)
  UNION ALL
  SELECT target, step + 1, CASE WHEN m < target THEN mid ELSE lo END, CASE WHEN m < target THEN hi ELSE mid END
  FROM (SELECT target, step, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT avg(1 / (1 + exp(-(ln(p / (1 - p)) + (lo + hi) / 2)))) FROM seg) AS m FROM bis WHERE step < 70)),
cst AS (SELECT target, (lo + hi) / 2 AS c FROM bis WHERE step = 70),
shifted AS (SELECT target, client_id, prior_credits <= 3 AS in_seg, p,
                   CASE WHEN prior_credits <= 3 THEN 1 / (1 + exp(-(ln(p / (1 - p)) + c))) ELSE p END AS pp FROM scored, cst)"""


@query("prior_shift", f"""WITH RECURSIVE {_shift_sql('(0.5)')}
SELECT client_id, round(p, 6) AS p, round(pp, 6) AS p_shifted FROM shifted""")
def prior_shift(fx):
    sh = C.prior_shift(fx.scored, "p", 0.5, out="p_shifted", where=F.col("prior_credits") <= 3)
    return sh.select("client_id", r("p").alias("p"), r("p_shifted").alias("p_shifted"))


@query("prior_sensitivity", f"""WITH RECURSIVE {_shift_sql('(0.30), (0.60), (0.85)')},
rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pp DESC, client_id) AS k FROM shifted)
SELECT target, round(avg(pp), 6) AS p_mean, round(sum(pp), 4) AS expected_losses,
       count(*) FILTER (WHERE in_seg AND k <= 100) AS segment_in_top100, count(*) FILTER (WHERE in_seg AND k <= 200) AS segment_in_top200
FROM rk GROUP BY target""")
def prior_sensitivity(fx):
    """For several targets, global mean, expected losses and first-segment rows among the top 100 / 200."""
    t = C.prior_sensitivity(fx.scored, "p", "client_id", F.col("prior_credits") <= 3, [0.30, 0.60, 0.85], [100, 200])
    return t.withColumn("p_mean", r("p_mean")).withColumn("expected_losses", r("expected_losses", 4))


@query("risk_segments", f"SELECT client_id, {SEG_SQL} AS segment FROM scored")
def risk_segments(fx):
    return fx.scored.select("client_id", C.risk_segment("p").alias("segment"))


@query("risk_decile_table", f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored),
d AS (SELECT CAST({DEC_SQL} AS INTEGER) AS decile, count(*) AS clients, avg(p) AS p_mean, min(p) AS p_min, max(p) AS p_max,
  sum(p) AS expected_losses, sum(balance) AS balance_at_risk, avg(CASE WHEN prior_credits = 1 THEN 1.0 ELSE 0.0 END) AS share_first_credit
  FROM t GROUP BY 1)
SELECT decile, clients, round(p_mean, 6) AS p_mean, p_min, p_max, round(expected_losses, 6) AS expected_losses,
  round(balance_at_risk, 2) AS balance_at_risk, round(share_first_credit, 6) AS share_first_credit,
  round(100 * sum(expected_losses) OVER (ORDER BY decile) / (SELECT sum(p) FROM scored), 6) AS cum_capture_pct,
  round(p_mean / (SELECT avg(p) FROM scored), 6) AS lift FROM d""")
def risk_decile_table(fx):
    t = C.risk_decile_table(fx.scored, "p", "client_id", "balance", "prior_credits")
    return t.select("decile", "clients", "p_min", "p_max", r("balance_at_risk", 2).alias("balance_at_risk"),
                    *[r(c).alias(c) for c in ["p_mean", "expected_losses", "share_first_credit",
                                              "cum_capture_pct", "lift"]])


@query("segment_table", f"""
WITH g AS (SELECT {SEG_SQL} AS segment, count(*) AS clients, avg(p) AS p_mean, sum(p) AS expected_losses, sum(balance) AS balance
  FROM scored GROUP BY 1)
SELECT segment, clients, round(p_mean, 6) AS p_mean, round(expected_losses, 6) AS expected_losses, round(balance, 6) AS balance,
  round(100 * balance / sum(balance) OVER (), 6) AS portfolio_pct FROM g""")
def segment_table(fx):
    t = C.segment_table(fx.scored, "p", "balance")
    return t.select("segment", "clients", r("balance", 2).alias("balance"),
                    *[r(c).alias(c) for c in ["p_mean", "expected_losses", "portfolio_pct"]])


@query("expected_value", f"""
SELECT client_id, round({VALUE_SQL}, 6) AS client_value, round({BENEFIT_SQL}, 6) AS expected_benefit,
  CASE WHEN {BENEFIT_SQL} > 0 THEN 'Yes' ELSE 'No' END AS recommend,
  row_number() OVER (ORDER BY {BENEFIT_SQL} DESC, client_id) AS priority FROM scored""")
def expected_value(fx):
    v = valued(fx)
    return v.select("client_id", r("client_value").alias("client_value"), r("expected_benefit").alias("expected_benefit"),
                    "recommend", "priority")


@query("campaign_scenarios", """
WITH e AS (SELECT CAST(eff AS DOUBLE) AS effectiveness FROM (VALUES (0.1), (0.2), (0.3)) t(eff)),
x AS (SELECT effectiveness, p, p * effectiveness * (granted * nominal_rate / 100.0 * 0.3) - 5000.0 AS b FROM scored, e),
g AS (SELECT effectiveness, count(*) FILTER (WHERE b > 0) AS selected, coalesce(sum(p) FILTER (WHERE b > 0), 0) AS losses_covered,
  coalesce(sum(p * effectiveness) FILTER (WHERE b > 0), 0) AS retentions, coalesce(sum(b) FILTER (WHERE b > 0), 0) AS benefit,
  count(*) AS n, sum(p) AS sp FROM x GROUP BY effectiveness)
SELECT effectiveness, selected, round(losses_covered, 6) AS losses_covered, round(retentions, 6) AS retentions,
  round(benefit, 3) AS benefit, round(selected / n, 6) AS share_selected, round(losses_covered / sp, 6) AS share_losses,
  round(selected * 5000.0, 6) AS cost, round(CASE WHEN selected > 0 THEN benefit / (selected * 5000.0) END, 6) AS roi FROM g""")
def campaign_scenarios(fx):
    sc = fx.scored.withColumn("client_value", F.col("granted") * F.col("nominal_rate") / 100.0 * F.lit(CFG.margin))
    t = C.campaign_scenarios(sc, "p", "client_value", EFFS, CFG.contact_cost)
    return t.select("effectiveness", "selected", r("benefit", 3).alias("benefit"),
                    *[r(c).alias(c) for c in ["losses_covered", "retentions", "share_selected", "share_losses", "cost", "roi"]])


@query("campaign_capacity", f"""
WITH t AS (SELECT p, balance, {BENEFIT_SQL} AS b, row_number() OVER (ORDER BY {BENEFIT_SQL} DESC, client_id) AS rk FROM scored),
k AS (SELECT CAST(c AS BIGINT) AS capacity FROM (VALUES (50), (100), (150), (200), (300)) v(c))
SELECT capacity, round(avg(p), 6) AS p_mean, round(sum(p), 6) AS expected_losses, round(sum(p * 0.2), 6) AS retentions,
  round(sum(balance), 2) AS balance_protected, round(sum(b), 3) AS benefit,
  round(sum(p) / (SELECT sum(p) FROM scored), 6) AS share_losses, round(capacity * 5000.0, 6) AS cost
FROM t, k WHERE rk <= capacity GROUP BY capacity""")
def campaign_capacity(fx):
    t = C.campaign_capacity(C.expected_value(fx.scored, "p", "granted", "nominal_rate", "client_id", CFG, priority=False),
                            "p", "client_id", "balance", CAPS, CFG)
    return t.select("capacity", r("balance_protected", 2).alias("balance_protected"), r("benefit", 3).alias("benefit"),
                    *[r(c).alias(c) for c in ["p_mean", "expected_losses", "retentions", "share_losses", "cost"]])


def _grid_sql():
    vals = ", ".join(f"({e}, {c}, {k})" for e in EFFS for c in GRID_COSTS for k in GRID_CAPS)
    return f"""
WITH g AS (SELECT CAST(e AS DOUBLE) AS effectiveness, CAST(c AS DOUBLE) AS cost, CAST(k AS BIGINT) AS capacity FROM (VALUES {vals}) v(e, c, k)),
t AS (SELECT p, balance, p * (granted * nominal_rate / 100.0 * 0.3) AS pv,
      row_number() OVER (ORDER BY p * (granted * nominal_rate / 100.0 * 0.3) DESC, client_id) AS rk FROM scored),
x AS (SELECT g.*, t.* FROM g, t WHERE t.rk <= g.capacity AND t.pv * g.effectiveness - g.cost > 0)
SELECT g.effectiveness, g.cost, g.capacity, count(x.rk) AS selected, round(coalesce(sum(x.p), 0), 6) AS expected_losses,
  round(g.effectiveness * coalesce(sum(x.p), 0), 6) AS retentions, round(coalesce(sum(x.balance), 0), 2) AS balance,
  round(g.effectiveness * coalesce(sum(x.pv), 0) - g.cost * count(x.rk), 3) AS benefit
FROM g LEFT JOIN x ON g.effectiveness = x.effectiveness AND g.cost = x.cost AND g.capacity = x.capacity
GROUP BY g.effectiveness, g.cost, g.capacity"""


@query("campaign_grid", _grid_sql())
def campaign_grid(fx):
    sc = fx.scored.withColumn("client_value", F.col("granted") * F.col("nominal_rate") / 100.0 * F.lit(CFG.margin))
    t = C.campaign_grid(sc, "p", "client_value", "client_id", "balance", EFFS, GRID_COSTS, GRID_CAPS)
    return t.select("effectiveness", "cost", "capacity", "selected",
                    r("balance", 2).alias("balance"), r("benefit", 3).alias("benefit"),
                    *[r(c).alias(c) for c in ["expected_losses", "retentions"]])


@query("score_output", f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored)
SELECT client_id, loan_id, p, CAST({DEC_SQL} AS INTEGER) AS decile, {SEG_SQL} AS segment,
  round({VALUE_SQL}, 6) AS client_value, round({BENEFIT_SQL}, 6) AS expected_benefit,
  row_number() OVER (ORDER BY {BENEFIT_SQL} DESC, client_id) AS priority,
  CASE WHEN {BENEFIT_SQL} > 0 THEN 'Yes' ELSE 'No' END AS recommend FROM t""")
def score_output(fx):
    v = O.with_deciles(valued(fx), "p", "client_id")
    return v.select("client_id", "loan_id", "p", "decile", C.risk_segment("p").alias("segment"),
                    r("client_value").alias("client_value"), r("expected_benefit").alias("expected_benefit"),
                    "priority", "recommend")


@query("kpi_row", f"""
SELECT count(*) AS clients, round(avg(p), 6) AS p_mean, round(sum(p), 6) AS expected_losses,
  count(*) FILTER (WHERE {SEG_SQL} = 'High') AS high_risk, round(sum(balance), 2) AS balance_total,
  round(sum(balance) FILTER (WHERE {SEG_SQL} = 'High'), 2) AS balance_high_risk,
  count(*) FILTER (WHERE {BENEFIT_SQL} > 0) AS campaign FROM scored""")
def kpi_row(fx):
    k = C.kpi_row(C.expected_value(fx.scored, "p", "granted", "nominal_rate", "client_id", CFG, priority=False), "p", "balance")
    return k.select("clients", r("p_mean").alias("p_mean"), r("expected_losses").alias("expected_losses"), "high_risk",
                    r("balance_total", 2).alias("balance_total"), r("balance_high_risk", 2).alias("balance_high_risk"), "campaign")


# ------------------------------------------------------------------ flagship
RULE_SQL = ("CASE WHEN least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5) < 0.15 "
            "OR (CASE WHEN upper(stage) = 'M2' THEN 2 WHEN upper(stage) = 'M3' THEN 3 ELSE 1 END) >= 2 THEN 1.0 ELSE 0.0 END")
FLAG_SCORE_SQL = f"CAST(0.5 * ({RULE_SQL}) + 0.5 * p AS DOUBLE)"


def flagship(fx):
    """portfolio → feature contract (P12) → business-rule score (M7, blended with the
    fixture score to break ties) → expected value (C8) → risk decile table (C6)."""
    feats, _ = FE.build_features(fx.scored)
    rule = ((F.col("ratio_balance") < 0.15) | (F.col("stage_num") >= 2)).cast("double")
    sc = feats.withColumn("score", 0.5 * rule + 0.5 * F.col("p"))
    v = C.expected_value(sc, "score", "granted", "nominal_rate", "client_id", CFG, priority=False)
    t = C.risk_decile_table(v, "score", "client_id", "balance", "prior_credits",
                            extra=[F.count_if(F.col("recommend") == "Yes").alias("_campaign")])
    from pyspark.sql import Window
    t = t.withColumn("campaign_clients", F.sum("_campaign").over(Window.partitionBy(F.lit(0))))   # ten rows
    return (t
            .select("decile", "clients", r("p_min").alias("p_min"), r("p_max").alias("p_max"),
                    r("balance_at_risk", 2).alias("balance_at_risk"),
                    *[r(c).alias(c) for c in ["p_mean", "expected_losses", "share_first_credit",
                                              "cum_capture_pct", "lift"]], "campaign_clients"))


@query("flagship", f"""
WITH s AS (SELECT *, {FLAG_SCORE_SQL} AS score FROM scored),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, client_id) AS rk, count(*) OVER () AS n FROM s),
d AS (SELECT CAST({DEC_SQL} AS INTEGER) AS decile, count(*) AS clients, avg(score) AS p_mean, min(score) AS p_min, max(score) AS p_max,
  sum(score) AS expected_losses, sum(balance) AS balance_at_risk, avg(CASE WHEN prior_credits = 1 THEN 1.0 ELSE 0.0 END) AS share_first_credit
  FROM t GROUP BY 1)
SELECT decile, clients, round(p_min, 6) AS p_min, round(p_max, 6) AS p_max, round(p_mean, 6) AS p_mean,
  round(expected_losses, 6) AS expected_losses, round(balance_at_risk, 2) AS balance_at_risk, round(share_first_credit, 6) AS share_first_credit,
  round(100 * sum(expected_losses) OVER (ORDER BY decile) / (SELECT sum(score) FROM s), 6) AS cum_capture_pct,
  round(p_mean / (SELECT avg(score) FROM s), 6) AS lift,
  (SELECT count(*) FROM s WHERE score * 0.2 * (granted * nominal_rate / 100.0 * 0.3) - 5000.0 > 0) AS campaign_clients FROM d""")
def flagship_query(fx):
    return flagship(fx)
