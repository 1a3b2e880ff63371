"""Segmentation operators (K1-K14): winsorising and robust scaling fitted on a base
population, k-means (MLlib), cluster-quality measures, agreement of labelings,
bootstrap stability and cluster profiles.

Points are handled in long form (point, dim, value) for the SQL-checkable measures, so
sums over dimensions are plain grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import with_totals
from ..session import ship_package
from . import kmeans_batch as kb
from .order import exact_quantiles


# ---------------------------------------------------------------- K1, K2
def fit_limits(base: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """K1 fit: exact p1 / p99 of each column in the base population (one row)."""
    from .audit import to_long
    q = exact_quantiles(to_long(base, cols), "value", [lo, hi], by=["variable"])
    return q.groupBy().pivot("variable", list(cols)).agg(
        F.max(F.when(F.col("q") == lo, F.col("value"))).alias("lo"), F.max(F.when(F.col("q") == hi, F.col("value"))).alias("hi"))


def winsorize(df: DataFrame, limits: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K1 apply: clip every column to its fitted limits (limits is one row)."""
    res = with_totals(df, limits)
    for c in cols:
        res = res.withColumn(c, F.least(F.greatest(F.col(c), F.col(f"{c}_lo")), F.col(f"{c}_hi")))
    return res.drop(*[f"{c}_{s}" for c in cols for s in ("lo", "hi")])


def fit_robust(base: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K2 fit: median and IQR per column (exact); IQR 0 → scale 1."""
    from .audit import to_long
    q = exact_quantiles(to_long(base, cols), "value", [0.25, 0.5, 0.75], by=["variable"])
    w = q.groupBy("variable").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("center"),
                                  (F.max(F.when(F.col("q") == 0.75, F.col("value")))
                                   - F.max(F.when(F.col("q") == 0.25, F.col("value")))).alias("iqr"))
    w = w.withColumn("scale", F.when(F.col("iqr") == 0, F.lit(1.0)).otherwise(F.col("iqr")))
    return w.groupBy().pivot("variable", list(cols)).agg(F.first("center").alias("center"), F.first("scale").alias("scale"))


def robust_scale(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K2 apply: (x − median) / IQR with the fitted one-row parameters."""
    res = with_totals(df, params)
    for c in cols:
        res = res.withColumn(c, (F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale"))
    return res.drop(*[f"{c}_{s}" for c in cols for s in ("center", "scale")])


# ---------------------------------------------------------------- K3, K4, K9, K14
def kmeans_best(points: DataFrame, k: int, seeds: Sequence[int] = (42, 43, 44), max_iter: int = 100,
                features: str = "features"):
    """K3: MLlib k-means from several seeds (k-means|| init), keep the least training
    cost."""
    best = None
    for s in seeds:
        m = KMeans(k=k, seed=s, maxIter=max_iter, featuresCol=features, predictionCol="cluster_k").fit(points)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1]


def to_points_long(df: DataFrame, id_col: str, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Vector column → long (id, kept columns, dim, value)."""
    from pyspark.ml.functions import vector_to_array
    return df.select(id_col, *keep, F.posexplode(vector_to_array(features)).alias("dim", "value"))


def choose_k(points: DataFrame, id_col: str, ks: Sequence[int] = range(2, 9), seeds: Sequence[int] = range(10),
             max_iter: int = 100) -> DataFrame:
    """K4: per k, inertia, silhouette (all points), Davies-Bouldin and Calinski-Harabasz of the best of ten starts.
    All starts of all k advance in one pass (:mod:`.kmeans_batch`)."""
    data = kb.keyed(points, id_col)
    runs = kb.fit_runs(data, [kb.Run(int(k), int(s)) for k in ks for s in seeds], max_iter)
    best = [kb.best_of([r for r in runs if r.k == k]) for k in ks]
    schema = "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double"
    if any(r.centres is None for r in best):     # no points
        return points.sparkSession.createDataFrame([(r.k, None, None, None, None) for r in best], schema)
    return points.sparkSession.createDataFrame([(r.k, float(r.cost), *q) for r, q in zip(best, kb.quality(data, best), strict=True)], schema)


def pca2(points: DataFrame, id_col: str, k: int = 2):
    """Two principal components with explained variance; each projected point keeps
    its own id and label in the same row (no second sampling)."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(points)
    from pyspark.ml.functions import vector_to_array
    proj = model.transform(points).withColumn("_pc", vector_to_array("pc"))
    # sign fix: make the largest-magnitude loading of each component positive
    load = model.pc.toArray()
    signs = [1.0 if load[np.argmax(np.abs(load[:, j])), j] >= 0 else -1.0 for j in range(k)]
    cols = [(F.col("_pc")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)]
    ev = [float(v) for v in model.explainedVariance.toArray()]
    return proj.select(id_col, *[c for c in points.columns if c not in (id_col, "features")], *cols), ev


# ---------------------------------------------------------------- K5-K8 on long points
def to_wide(lng: DataFrame, id_col: str, cluster: str = "cluster") -> DataFrame:
    """Long points → one row (id, cluster, v) with the values in dimension order."""
    return lng.groupBy(id_col, cluster).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_v")) \
        .select(id_col, cluster, F.transform("_v", lambda x: x["value"].cast("double")).alias("v"))


def silhouette(lng: DataFrame, id_col: str, cluster: str = "cluster") -> DataFrame:
    """K5: mean silhouette over ALL points with squared Euclidean distances.

    The mean squared distance of a point x to a cluster needs only the cluster's size n, sum S and sum of
    squared norms Q: (n |x|² + Q − 2 x·S) / n. So one aggregate per cluster replaces all pairs; the
    cluster table (one row per cluster) is attached to every point. Own cluster: divided by n − 1."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    wide = to_wide(lng, id_col, cluster).withColumn("_q", dot(F.col("v"), F.col("v")))
    sums = lng.groupBy(cluster, "dim").agg(F.sum(F.col("value").cast("double")).alias("_s")) \
        .groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("dim", "_s"))).alias("_s")) \
        .select(cluster, F.transform("_s", lambda x: x["_s"]).alias("s"))
    stats = wide.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q")).join(sums, cluster)
    table = stats.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "q", "s")).alias("_all"))   # k rows
    x = with_totals(wide, table)
    total = lambda o: o["n"] * F.col("_q") + o["q"] - 2 * dot(F.col("v"), o["s"])
    own = F.element_at(F.filter("_all", lambda o: o["c"].eqNullSafe(F.col(cluster))), 1)
    other = F.array_min(F.transform(F.filter("_all", lambda o: ~o["c"].eqNullSafe(F.col(cluster))), lambda o: F.greatest(total(o) / o["n"], F.lit(0.0))))
    a = F.greatest(F.try_divide(total(own), own["n"] - 1), F.lit(0.0))
    x = x.select(own["n"].alias("n"), a.alias("a"), other.alias("b"))
    s = F.when((F.col("n") <= 1) | F.col("b").isNull(), F.lit(0.0)) \
        .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return x.agg(F.avg(s).alias("silhouette"))


#: Points of a block of the Euclidean silhouette; a unit of work holds two blocks and a square of distances.
BLOCK_POINTS = 1000


def _block_sums(part: pd.DataFrame) -> pd.DataFrame:
    """Distances between the points of two blocks (or within one), summed per (point, cluster of the other)."""
    lo, hi = part["x"].iloc[0], part["y"].iloc[0]
    sides = [part[part["block"] == lo], part[part["block"] == hi]]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"i": part["i"].iloc[:0], "ci": part["ci"].iloc[:0], "cj": part["ci"].iloc[:0], "t": np.zeros(0), "n": np.zeros(0, np.int64)})
    a, b = (np.array(s["v"].tolist(), dtype=np.float64) for s in sides)
    d = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):      # exact differences, one dimension at a time
        d += (a[:, k, None] - b[None, :, k]) ** 2
    d = np.sqrt(d)
    out = []
    for own, other, dist in [(sides[0], sides[1], d)] + ([(sides[1], sides[0], d.T)] if lo != hi else []):
        codes, names = pd.factorize(other["ci"])
        for c, name in enumerate(names):
            cols = codes == c
            n = np.full(len(own), cols.sum(), np.int64)
            if lo == hi:
                n -= cols            # a point is no neighbour of itself
            out.append(pd.DataFrame({"i": own["i"].to_numpy(), "ci": own["ci"].to_numpy(), "cj": name, "t": dist[:, cols].sum(axis=1), "n": n}))
    return pd.concat(out)


def silhouette_sampled(lng: DataFrame, id_col: str, n_sample: int = 10_000, cluster: str = "cluster", seed: int = 42) -> DataFrame:
    """K5, Euclidean, over the ``n_sample`` points (a number the caller names) with the smallest keyed md5:
    (silhouette, n_points, n_used), so the result says how much it stands for.

    The sample is dealt into blocks of about 1,000 points; each pair of blocks is one unit of dense distance
    work, whose sums per (point, cluster) are added up by Spark. Nothing goes through the driver. Points have
    a value in every dimension and a cluster."""
    ship_package(lng.sparkSession)
    wide = to_wide(lng, id_col, cluster)
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    blocks = -(-n_sample // BLOCK_POINTS)
    picked = wide.withColumn("_h", h).orderBy("_h", id_col).limit(n_sample) \
        .select(F.col(id_col).alias("i"), F.col(cluster).alias("ci"), "v", F.pmod(F.xxhash64("_h"), F.lit(blocks)).cast("int").alias("block"))
    units = picked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select("i", "ci", "v", "block", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"))
    ti, tc = (wide.schema[c].dataType.simpleString() for c in (id_col, cluster))
    sums = units.groupBy("x", "y").applyInPandas(_block_sums, f"i {ti}, ci {tc}, cj {tc}, t double, n long")
    per = sums.groupBy("i", "ci", "cj").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    pt = per.groupBy("i").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.try_divide("t", "n"))).alias("a"),
                              F.max(F.when(F.col("ci") == F.col("cj"), F.col("n"))).alias("others"),
                              F.min(F.when(F.col("ci") != F.col("cj"), F.try_divide("t", "n"))).alias("b"))
    s = F.when((F.col("others") == 0) | F.col("b").isNull(), F.lit(0.0)) \
        .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    n = lng.agg(F.countDistinct(id_col).alias("n_points"))
    return with_totals(pt.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n_used")), n)


def _centroids(lng: DataFrame, cluster: str) -> DataFrame:
    return lng.groupBy(cluster, "dim").agg(F.avg("value").alias("c"))


def davies_bouldin(lng: DataFrame, id_col: str, cluster: str = "cluster") -> DataFrame:
    """K6: mean over clusters of max_j (s_i + s_j) / d_ij, s_i = mean distance of members
    to their centroid. The k×k comparison runs on the k-row centroid table (one array)."""
    cen = _centroids(lng, cluster)
    dist = (lng.join(F.broadcast(cen), [cluster, "dim"]).groupBy(id_col, cluster)   # k × dims rows
            .agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("c"), 2))).alias("d")))
    s = dist.groupBy(cluster).agg(F.avg("d").alias("s"))
    cv = cen.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("_c")) \
        .select(cluster, F.transform("_c", lambda x: x["c"]).alias("cv"))
    tab = cv.join(s, cluster)
    allc = tab.agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "cv", "s")).alias("all"))   # k rows
    x = with_totals(tab, allc)
    other = F.filter("all", lambda o: o["k"] != F.col(cluster))
    ratio = F.transform(other, lambda o: F.try_divide(F.col("s") + o["s"], F.sqrt(F.aggregate(
        F.zip_with("cv", o["cv"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))))
    return x.select(F.array_max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(lng: DataFrame, id_col: str, cluster: str = "cluster") -> DataFrame:
    """K7: [B / (k − 1)] / [W / (n − k)]."""
    cen = _centroids(lng, cluster)
    glob = lng.groupBy("dim").agg(F.avg("value").alias("g"))
    nc = lng.select(id_col, cluster).distinct().groupBy(cluster).agg(F.count(F.lit(1)).alias("nc"))
    W = lng.join(F.broadcast(cen), [cluster, "dim"]).agg(F.sum(F.pow(F.col("value") - F.col("c"), 2)).alias("W"))
    Bt = cen.join(glob, "dim").join(nc, cluster).agg(F.sum(F.col("nc") * F.pow(F.col("c") - F.col("g"), 2)).alias("B"),
                                                     F.countDistinct(cluster).alias("k"), F.sum(F.when(F.col("dim") == 0, F.col("nc"))).alias("n"))
    return W.crossJoin(Bt).select(F.try_divide(F.try_divide(F.col("B"), F.col("k") - 1), F.try_divide(F.col("W"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """K8: adjusted Rand index from the contingency table."""
    def c2(x):
        return x * (x - 1) / 2.0
    cont = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("nij"))
    sa = cont.groupBy(a).agg(F.sum("nij").alias("ai")).agg(F.sum(c2(F.col("ai"))).alias("sa"))
    sb = cont.groupBy(b).agg(F.sum("nij").alias("bj")).agg(F.sum(c2(F.col("bj"))).alias("sb"))
    sij = cont.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    x = sij.crossJoin(sa).crossJoin(sb)
    exp = F.col("sa") * F.col("sb") / c2(F.col("n"))
    mx = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (mx - exp)).alias("ari"))


def bootstrap_stability(points: DataFrame, id_col: str, ks: Sequence[int] = range(3, 8), n_boot: int = 10,
                        seeds: Sequence[int] = range(10), max_iter: int = 100) -> DataFrame:
    """K9: per k, models fitted on Poisson bootstrap resamples (best of all starts each) against the base model;
    mean, min and population std of the ARIs on the resamples. All k, resamples and starts advance in one pass."""
    data = kb.keyed(points, id_col)
    runs = kb.fit_runs(data, [kb.Run(int(k), int(s), b) for k in ks for b in (None, *range(n_boot)) for s in seeds], max_iter)
    schema = "k int, ari_mean double, ari_min double, ari_std double"
    if any(r.centres is None for r in runs):     # no points
        return points.sparkSession.createDataFrame([(int(k), None, None, None) for k in ks], schema)
    best = {(k, b): kb.best_of([r for r in runs if r.k == k and r.resample == b]) for k in ks for b in (None, *range(n_boot))}
    pairs = [(best[k, None], best[k, b]) for k in ks for b in range(n_boot)]
    found = np.array(kb.agreement(data, pairs)).reshape(len(list(ks)), n_boot)
    return points.sparkSession.createDataFrame(
        [(int(k), float(a.mean()), float(a.min()), float(a.std())) for k, a in zip(ks, found, strict=True)], schema)


# ---------------------------------------------------------------- K10, K11, K13
#: Medians of a profile; the mean stage (M1 = 1, M2 = 2, M3 = 3) is indexed with them.
PROFILE_MEDIANS = ("granted", "balance", "balance_ratio", "prior_credits", "nominal_rate")
INDEXED = (*PROFILE_MEDIANS, "mean_stage")


def _profiled(clients: DataFrame) -> DataFrame:
    return clients.withColumn("balance_ratio", F.try_divide(F.col("balance"), F.col("granted"))) \
        .withColumn("stage_num", F.regexp_extract("stage", "([0-9]+)", 1).try_cast("double"))


def _medians(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact medians of all profile variables per group, in one refinement."""
    lng = x.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in PROFILE_MEDIANS])).alias("_s")) \
        .select(*by, "_s.variable", "_s.value")
    q = exact_quantiles(lng, "value", [0.5], by=[*by, "variable"])
    return q.groupBy(*by).pivot("variable", list(PROFILE_MEDIANS)).agg(F.first("value"))


def cluster_profile(base: DataFrame, active: DataFrame | None = None, cluster: str = "cluster") -> DataFrame:
    """Per cluster n, rate of ``y``, medians, mean stage, shares (stage 2 or 3, first credit, women), balance and
    shares of clients and of the portfolio, with the other population's count and balance (NULL without members)."""
    x = _profiled(base)
    share = lambda cond: F.avg(cond.cast("double"))
    g = x.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg("stage_num").alias("mean_stage"), share(F.col("stage_num") >= 2).alias("share_stage23"),
        share(F.col("prior_credits") == 1).alias("share_first"), share(F.upper(F.trim("sex")) == "F").alias("share_women"), F.sum("balance").alias("total_balance"))
    g = g.join(_medians(x, [cluster]), cluster)
    total = g.agg(F.sum("n").alias("_n"), F.sum("total_balance").alias("_b"))
    g = with_totals(g, total).withColumn("clients_pct", 100.0 * F.col("n") / F.col("_n")) \
        .withColumn("portfolio_pct", F.try_divide(100.0 * F.col("total_balance"), F.col("_b"))).drop("_n", "_b")
    if active is None:
        return g
    return g.join(active.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_active"), F.sum("balance").alias("balance_active")), cluster, "left")


def cluster_index(profile: DataFrame, base: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A profile's medians and mean stage against those of the whole population = 100."""
    x = _profiled(base)
    one = with_totals(_medians(x, []), x.agg(F.avg("stage_num").alias("mean_stage")))
    whole = one.select(*[F.col(c).alias(f"_g_{c}") for c in INDEXED])
    return with_totals(profile, whole).select(cluster, *[F.try_divide(100.0 * F.col(c), F.col(f"_g_{c}")).alias(f"idx_{c}") for c in INDEXED])


def cluster_active_summary(active: DataFrame, profile: DataFrame, cluster: str = "cluster", p: str = "p", recommend: str = "recommend") -> DataFrame:
    """Active members with mean and expected losses, balance and campaign count, beside the historic rate and
    share of clients (NULL for a cluster without history)."""
    g = active.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_active"), F.avg(p).alias("p_active"), F.sum(p).alias("expected_losses"),
                                    F.sum("balance").alias("balance_active"), F.count_if(F.col(recommend) == "Yes").alias("campaign"))
    return g.join(profile.select(cluster, F.col("rate").alias("hist_rate"), "clients_pct"), cluster, "left")
