"""Checked queries for window / order operators (W*) and metrics (E*) on ``scored``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import metrics as M
from ..operators import order as O
from .registry import query, r

DEC_SQL = "CASE WHEN n <= 1 THEN 1 ELSE greatest(1, CAST(floor((10 * (rk - 1) + n - 2) / (n - 1)) AS INTEGER)) END"


@query("rank_first", """
SELECT client_id, row_number() OVER (ORDER BY p DESC, client_id) AS rank FROM scored""")
def rank_first(fx):
    return O.global_rank(fx.scored, "p", "client_id").select("client_id", "rank")


@query("rank_average", """
SELECT client_id, round((rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER (), 6) AS mid_rank
FROM scored""")
def rank_average(fx):
    return O.mid_rank(fx.scored, "p").select("client_id", r("mid_rank").alias("mid_rank"))


@query("decile", f"""
WITH t AS (SELECT client_id, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored)
SELECT client_id, CAST({DEC_SQL} AS INTEGER) AS decile FROM t""")
def decile(fx):
    return O.with_deciles(fx.scored, "p", "client_id").select("client_id", "decile")




@query("quantile_bins", """
WITH q AS (SELECT quantile_cont(balance, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM portfolio),
e AS (SELECT list_sort(list_distinct(e)) AS e FROM q),
b AS (SELECT client_id, balance, y, e FROM portfolio, e)
SELECT CAST(CASE WHEN balance = e[1] THEN 1 ELSE len(list_filter(e, lambda x: x < balance)) END AS INTEGER) AS bin,
       count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate
FROM b GROUP BY 1""")
def quantile_bins(fx):
    p = fx.portfolio
    edges = O.quantile_bin_edges(p, "balance", 10)
    b = F.when(F.col("balance") == F.lit(edges[0]), F.lit(1)).otherwise(S.count_below("balance", edges))
    return (p.withColumn("bin", b.cast("int")).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate")))


@query("cum_share", f"""
WITH t AS (SELECT p, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored),
d AS (SELECT CAST({DEC_SQL} AS INTEGER) AS decile, sum(p) AS losses FROM t GROUP BY 1)
SELECT decile, round(losses, 6) AS losses, round(100 * sum(losses) OVER (ORDER BY decile) / sum(losses) OVER (), 6) AS cum_share_pct FROM d""")
def cum_share(fx):
    d = O.with_deciles(fx.scored, "p", "client_id").groupBy("decile").agg(F.sum("p").alias("losses"))
    return O.cum_share(d, "decile", "losses").select("decile", r("losses").alias("losses"), r("cum_share_pct").alias("cum_share_pct"))


@query("cum_gain", """
WITH t AS (SELECT row_number() OVER (ORDER BY p DESC, client_id) AS rank,
  sum(p) OVER (ORDER BY p DESC, client_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
  count(*) OVER () AS n, sum(p) OVER () AS v FROM scored)
SELECT rank, round(rank / n, 6) AS share_rows, round(c / v, 6) AS cum_gain FROM t WHERE (rank - 1) % 100 = 0""")
def cum_gain(fx):
    g = O.cum_gain(fx.scored, "p", "client_id", "p", every=100)
    return g.select("rank", r("share_rows").alias("share_rows"), r("cum_gain").alias("cum_gain"))


# ------------------------------------------------------------------ metrics
AUC_SQL = """
WITH s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
c AS (SELECT p, pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before FROM s)
SELECT round(sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc_roc FROM c"""


@query("auc_roc", AUC_SQL)
def auc_roc(fx):
    return M.auc_roc(fx.scored, "p", "y").select(r("auc_roc").alias("auc_roc"))


DESC_CUM = """
s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM s)"""


@query("avg_precision", f"""WITH {DESC_CUM}
SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS avg_precision FROM c""")
def avg_precision(fx):
    return M.avg_precision(fx.scored, "p", "y").select(r("avg_precision").alias("avg_precision"))


@query("ks_model", f"""WITH {DESC_CUM}
SELECT round(greatest(max(tp / (SELECT sum(y) FROM scored) - fp / (SELECT sum(1 - y) FROM scored)), 0), 6) AS ks FROM c""")
def ks_model(fx):
    return M.ks_model(fx.scored, "p", "y").select(r("ks").alias("ks"))


@query("brier", "SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM scored")
def brier(fx):
    return M.brier(fx.scored, "p", "y").select(r("brier").alias("brier"))


TOP_SQL = """
WITH t AS (SELECT y, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored)"""


@query("lift_topk", TOP_SQL + """
SELECT round(avg(CASE WHEN rk <= floor(n * 0.1) THEN y END) / avg(y), 6) AS lift FROM t""")
def lift_topk(fx):
    return M.lift_topk(fx.scored, "p", "y", "client_id", 1).select(r("lift").alias("lift"))


@query("capture_topk", TOP_SQL + """
SELECT round(sum(CASE WHEN rk <= floor(n * 0.2) THEN y END) / sum(y), 6) AS capture FROM t""")
def capture_topk(fx):
    return M.capture_topk(fx.scored, "p", "y", "client_id", 0.2).select(r("capture").alias("capture"))


@query("decile_table", f"""
WITH t AS (SELECT p, y, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored),
d AS (SELECT CAST({DEC_SQL} AS INTEGER) AS decile, count(*) AS n, avg(p) AS mean_pred, avg(CAST(y AS DOUBLE)) AS observed,
      sum(y) AS positives FROM t GROUP BY 1)
SELECT decile, n, round(mean_pred, 6) AS mean_pred, round(observed, 6) AS observed, CAST(positives AS BIGINT) AS positives,
  round(observed / (SELECT avg(CAST(y AS DOUBLE)) FROM scored), 6) AS lift,
  round(100.0 * sum(positives) OVER (ORDER BY decile) / (SELECT sum(y) FROM scored), 6) AS cum_capture_pct FROM d""")
def decile_table(fx):
    d = M.decile_table(fx.scored, "p", "y", "client_id")
    return d.select("decile", "n", r("mean_pred").alias("mean_pred"), r("observed").alias("observed"),
                    F.col("positives").cast("long").alias("positives"), r("lift").alias("lift"),
                    r("cum_capture_pct").alias("cum_capture_pct"))


@query("evaluate", f"""
WITH a AS ({AUC_SQL.replace('SELECT round(sum(pos * (neg_before', 'SELECT round(sum(pos * (neg_before')}),
{DESC_CUM.strip().replace('s AS (', 's2 AS (', 1).replace('FROM s)', 'FROM s2)').replace('c AS (', 'c2 AS (', 1)},
t AS (SELECT y, row_number() OVER (ORDER BY p DESC, client_id) AS rk, count(*) OVER () AS n FROM scored)
SELECT 'score' AS model,
  (SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) FROM c2) AS auc_pr,
  (SELECT auc_roc FROM a) AS auc_roc,
  (SELECT round(greatest(max(tp / (SELECT sum(y) FROM scored) - fp / (SELECT sum(1 - y) FROM scored)), 0), 6) FROM c2) AS ks,
  (SELECT round(avg((p - y) * (p - y)), 6) FROM scored) AS brier,
  (SELECT round(avg(CASE WHEN rk <= floor(n * 0.1) THEN y END) / avg(y), 6) FROM t) AS lift_decile_1,
  (SELECT round(sum(CASE WHEN rk <= floor(n * 0.2) THEN y END) / sum(y), 6) FROM t) AS capture_top20""")
def evaluate(fx):
    e = M.evaluate(fx.scored, "p", "y", "client_id", "score")
    return e.select("model", *[r(c).alias(c) for c in ["auc_pr", "auc_roc", "ks", "brier", "lift_decile_1", "capture_top20"]])


@query("reliability_curve", """
WITH q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS inner_e FROM scored),
b AS (SELECT p, y, len(list_filter(inner_e, lambda x: x < p)) AS bin FROM scored, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(CAST(y AS DOUBLE)), 6) AS frac_pos FROM b GROUP BY 1""")
def reliability_curve(fx):
    c = M.reliability_curve(fx.scored, "p", "y", 10)
    return c.select("bin", "n", r("mean_pred").alias("mean_pred"), r("frac_pos").alias("frac_pos"))
