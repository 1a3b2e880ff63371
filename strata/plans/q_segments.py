"""Checked queries for segmentation operators (K*). Given labels: ``emb_long`` clusters
are the embedding labels; portfolio clusters are the product segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as C
from ..operators import segments as K
from .q_campaign import BENEFIT_SQL, CFG, SEG_SQL
from ..session import materialize
from .registry import query, r

WCOLS = ["granted", "balance"]


@query("winsorize", """
WITH l AS (SELECT quantile_cont(granted, 0.01) AS g_lo, quantile_cont(granted, 0.99) AS g_hi,
                  quantile_cont(balance, 0.01) AS b_lo, quantile_cont(balance, 0.99) AS b_hi FROM portfolio_base)
SELECT client_id, round(least(greatest(granted, g_lo), g_hi), 6) AS granted, round(least(greatest(balance, b_lo), b_hi), 6) AS balance
FROM portfolio_active, l""")
def winsorize(fx):
    lim = K.fit_limits(fx.portfolio_base, WCOLS)
    w = K.winsorize(fx.portfolio_active.select("client_id", *WCOLS), lim, WCOLS)
    return w.select("client_id", *[r(c).alias(c) for c in WCOLS])


RCOLS = ["granted", "balance", "nominal_rate"]


@query("robust_scale", "WITH " + ", ".join(
    f"p_{c} AS (SELECT quantile_cont({c}, 0.5) AS m, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
    f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s FROM portfolio_base)" for c in RCOLS)
    + " SELECT client_id, " + ", ".join(f"round(({c} - p_{c}.m) / p_{c}.s, 6) AS {c}" for c in RCOLS)
    + " FROM portfolio_active, " + ", ".join(f"p_{c}" for c in RCOLS))
def robust_scale(fx):
    prm = K.fit_robust(fx.portfolio_base, RCOLS)
    s = K.robust_scale(fx.portfolio_active.select("client_id", *RCOLS), prm, RCOLS)
    return s.select("client_id", *[r(c).alias(c) for c in RCOLS])


def _silhouette_sql(points: str, dist: str) -> str:
    return f"""cl AS (SELECT vec_id, min(cluster) AS cluster FROM {points} GROUP BY vec_id),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, {dist} AS dist
      FROM {points} a JOIN {points} b ON a.dim = b.dim GROUP BY 1, 2),
m AS (SELECT d.i, cj.cluster AS cj, sum(dist) AS s, count(*) FILTER (WHERE d.i <> d.j) AS c FROM d JOIN cl cj ON cj.vec_id = d.j GROUP BY 1, 2),
own AS (SELECT m.i, m.s / m.c AS a FROM m JOIN cl ON cl.vec_id = m.i AND cl.cluster = m.cj),
oth AS (SELECT m.i, min(m.s / m.c) AS b FROM m JOIN cl ON cl.vec_id = m.i AND cl.cluster <> m.cj GROUP BY m.i),
sz AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster),
sil AS (SELECT avg(CASE WHEN sz.n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n_used
        FROM own JOIN oth USING (i) JOIN cl ON cl.vec_id = own.i JOIN sz ON sz.cluster = cl.cluster)"""


@query("silhouette", f"""WITH {_silhouette_sql('emb_long', 'sum((a.value - b.value) * (a.value - b.value))')}
SELECT round(silhouette, 6) AS silhouette FROM sil""")
def silhouette(fx):
    return K.silhouette(fx.emb_long, "vec_id").select(r("silhouette").alias("silhouette"))


SAMPLE = 10_000


@query("silhouette_sampled", f"""
WITH pick AS (SELECT vec_id FROM (SELECT DISTINCT vec_id FROM emb_long) ORDER BY md5(vec_id || '|42'), vec_id LIMIT {SAMPLE}),
sp AS (SELECT emb_long.* FROM emb_long JOIN pick USING (vec_id)),
{_silhouette_sql('sp', 'sqrt(sum((a.value - b.value) * (a.value - b.value)))')}
SELECT round(silhouette, 6) AS silhouette, n_used, (SELECT count(DISTINCT vec_id) FROM emb_long) AS n_points FROM sil""")
def silhouette_sampled(fx):
    s = K.silhouette_sampled(fx.emb_long, "vec_id", SAMPLE)
    return s.select(r("silhouette").alias("silhouette"), "n_used", "n_points")


@query("davies_bouldin", """
WITH cen AS (SELECT cluster, dim, avg(value) AS c FROM emb_long GROUP BY 1, 2),
dist AS (SELECT vec_id, e.cluster, sqrt(sum((value - c) * (value - c))) AS d FROM emb_long e JOIN cen USING (cluster, dim) GROUP BY 1, 2),
s AS (SELECT cluster, avg(d) AS s FROM dist GROUP BY 1),
cc AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dij FROM cen a JOIN cen b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2),
rr AS (SELECT i, max((si.s + sj.s) / dij) AS r FROM cc JOIN s si ON si.cluster = i JOIN s sj ON sj.cluster = j GROUP BY i)
SELECT round(avg(r), 6) AS davies_bouldin FROM rr""")
def davies_bouldin(fx):
    return K.davies_bouldin(fx.emb_long, "vec_id").select(r("davies_bouldin").alias("davies_bouldin"))


@query("calinski_harabasz", """
WITH cen AS (SELECT cluster, dim, avg(value) AS c FROM emb_long GROUP BY 1, 2),
g AS (SELECT dim, avg(value) AS g FROM emb_long GROUP BY dim),
nc AS (SELECT cluster, count(DISTINCT vec_id) AS nc FROM emb_long GROUP BY cluster),
w AS (SELECT sum((value - c) * (value - c)) AS w FROM emb_long JOIN cen USING (cluster, dim)),
b AS (SELECT sum(nc * (c - g) * (c - g)) AS b FROM cen JOIN g USING (dim) JOIN nc USING (cluster)),
k AS (SELECT count(*) AS k, sum(nc) AS n FROM nc)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM w, b, k""")
def calinski_harabasz(fx):
    return K.calinski_harabasz(fx.emb_long, "vec_id").select(r("calinski_harabasz").alias("calinski_harabasz"))


@query("ari", """
WITH t AS (SELECT label AS a, list_position(embedding, list_max(embedding)) - 1 AS b FROM embeddings),
c AS (SELECT a, b, count(*) AS nij FROM t GROUP BY 1, 2),
x AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM c),
sa AS (SELECT sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS ai FROM c GROUP BY a)),
sb AS (SELECT sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS bj FROM c GROUP BY b))
SELECT round(CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0
  ELSE (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) END, 6) AS ari FROM x, sa, sb""")
def ari(fx):
    e = fx.t("embeddings", "label", "embedding")
    t = e.select(F.col("label").alias("a"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("b"))
    return K.ari(t, "a", "b").select(r("ari").alias("ari"))


@query("kmeans")
def kmeans(fx):
    """Rows-only: MLlib k-means (k = 10, best of 3 seeds); one cluster id per point."""
    pts = fx.emb_vectors
    m = K.kmeans_best(pts, 10, (42, 43, 44))
    return m.transform(pts).select("vec_id", F.col("cluster_k").alias("cluster"))


@query("choose_k")
def choose_k(fx):
    """Rows-only: k = 2..8, best of ten starts, with inertia, silhouette, Davies-Bouldin, Calinski-Harabasz."""
    return K.choose_k(fx.emb_vectors, "vec_id", range(2, 9))


@query("bootstrap_stability")
def bootstrap_stability(fx):
    """Rows-only: 10 Poisson bootstraps for k = 3..7, ten starts each, ARI on the resample."""
    return K.bootstrap_stability(fx.emb_vectors, "vec_id", range(3, 8), n_boot=10)


@query("pca2")
def pca2(fx):
    """Rows-only: two components per point with its own label; explained variance as columns."""
    proj, ev = K.pca2(fx.emb_vectors, "vec_id")
    return proj.withColumn("ev1", F.lit(ev[0])).withColumn("ev2", F.lit(ev[1]))


PROFILE_SQL = """
x AS (SELECT *, product AS cluster, balance / granted AS balance_ratio, CAST(substr(stage, 2) AS DOUBLE) AS stage_num FROM portfolio_base),
pr AS (SELECT cluster, count(*) AS n, avg(CAST(y AS DOUBLE)) AS rate, median(granted) AS granted, median(balance) AS balance,
         median(balance_ratio) AS balance_ratio, median(CAST(prior_credits AS DOUBLE)) AS prior_credits, median(nominal_rate) AS nominal_rate,
         avg(stage_num) AS mean_stage, avg(CASE WHEN stage_num >= 2 THEN 1.0 ELSE 0.0 END) AS share_stage23,
         avg(CASE WHEN prior_credits = 1 THEN 1.0 ELSE 0.0 END) AS share_first,
         avg(CASE WHEN upper(trim(sex)) = 'F' THEN 1.0 ELSE 0.0 END) AS share_women, sum(balance) AS total_balance FROM x GROUP BY 1)"""
MEASURES = ["rate", *K.INDEXED, "share_stage23", "share_first", "share_women", "clients_pct", "portfolio_pct"]


def by_product(df):
    return df.withColumn("cluster", F.col("product"))


@query("profile_clusters", f"""
WITH {PROFILE_SQL},
a AS (SELECT product AS cluster, count(*) AS n_active, sum(balance) AS balance_active FROM portfolio_active GROUP BY 1),
w AS (SELECT *, 100.0 * n / sum(n) OVER () AS clients_pct, 100 * total_balance / sum(total_balance) OVER () AS portfolio_pct FROM pr)
SELECT cluster, n, round(total_balance, 2) AS total_balance, n_active, round(balance_active, 2) AS balance_active,
  {', '.join(f'round({c}, 6) AS {c}' for c in MEASURES)} FROM w LEFT JOIN a USING (cluster)""")
def profile_clusters(fx):
    g = K.cluster_profile(by_product(fx.portfolio_base), by_product(fx.portfolio_active))
    return g.select("cluster", "n", "n_active", r("total_balance", 2).alias("total_balance"), r("balance_active", 2).alias("balance_active"),
                    *[r(c).alias(c) for c in MEASURES])


@query("cluster_index", f"""
WITH {PROFILE_SQL},
g AS (SELECT median(granted) AS granted, median(balance) AS balance, median(balance_ratio) AS balance_ratio,
        median(CAST(prior_credits AS DOUBLE)) AS prior_credits, median(nominal_rate) AS nominal_rate, avg(stage_num) AS mean_stage FROM x)
SELECT cluster, {', '.join(f'round(100 * pr.{c} / g.{c}, 6) AS idx_{c}' for c in K.INDEXED)} FROM pr, g""")
def cluster_index(fx):
    base = by_product(fx.portfolio_base)
    res = K.cluster_index(K.cluster_profile(base), base)
    return res.select("cluster", *[r(f"idx_{c}").alias(f"idx_{c}") for c in K.INDEXED])


@query("cluster_risk_cross", f"""
SELECT product AS cluster, {SEG_SQL} AS segment, count(*) AS n, round(sum(balance), 2) AS balance FROM scored GROUP BY 1, 2""")
def cluster_risk_cross(fx):
    return (fx.scored.groupBy(F.col("product").alias("cluster"), C.risk_segment("p").alias("segment"))
            .agg(F.count(F.lit(1)).alias("n"), r(F.sum("balance"), 2).alias("balance")))


@query("cluster_vs_active", f"""
WITH {PROFILE_SQL},
w AS (SELECT cluster, rate, 100.0 * n / sum(n) OVER () AS clients_pct FROM pr),
a AS (SELECT product AS cluster, count(*) AS n_active, avg(p) AS p_active, sum(p) AS expected_losses, sum(balance) AS balance_active,
        count(*) FILTER (WHERE {BENEFIT_SQL} > 0) AS campaign FROM scored WHERE client_id % 5 = 0 GROUP BY 1)
SELECT cluster, n_active, round(p_active, 6) AS p_active, round(expected_losses, 6) AS expected_losses, round(balance_active, 2) AS balance_active,
  campaign, round(rate, 6) AS hist_rate, round(clients_pct, 6) AS clients_pct FROM a LEFT JOIN w USING (cluster)""")
def cluster_vs_active(fx):
    v = C.expected_value(fx.scored.where(F.col("client_id") % 5 == 0), "p", "granted", "nominal_rate", "client_id", CFG, priority=False)
    g = K.cluster_active_summary(by_product(v), K.cluster_profile(by_product(fx.portfolio_base)))
    return g.select("cluster", "n_active", "campaign", r("balance_active", 2).alias("balance_active"),
                    *[r(c).alias(c) for c in ["p_active", "expected_losses", "hist_rate", "clients_pct"]])


CLUSTERED = ("granted", "balance", "prior_credits", "nominal_rate")


@query("profile_fitted_clusters")
def profile_fitted_clusters(fx):
    """Rows-only: the profile of fitted clusters (k = 6, best of ten starts) on robustly scaled variables."""
    from pyspark.ml.feature import VectorAssembler
    from ..operators import kmeans_batch as kb

    base = materialize(fx.portfolio_base)      # read by scaling, labels and every pass of the medians
    scaled = K.robust_scale(base, K.fit_robust(base, CLUSTERED), CLUSTERED).select("client_id", *CLUSTERED)
    points = VectorAssembler(inputCols=list(CLUSTERED), outputCol="features").transform(scaled).select("client_id", "features")
    best = kb.best_of(kb.fit_runs(kb.keyed(points, "client_id"), [kb.Run(6, s) for s in range(10)]))
    label = kb.label(points, "client_id", best)
    return K.cluster_profile(materialize(base.join(label, "client_id"))).select("cluster", "n", *[r(c).alias(c) for c in MEASURES])
