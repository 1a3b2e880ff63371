"""Audit and drift operators (D1-D12). Variables are handled in *long* form
(variable, value) so one distributed job covers every variable — no driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import with_totals
from ..functions.scalar import count_below
from ..session import materialize
from .metrics import auc_of_table, auc_roc
from .order import exact_quantiles, ordered_cumulative, score_table

PSI_FLOOR = 1e-6   # fixed value: share floor for empty bins


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to (keep…, variable, value double)."""
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols]))
    return df.select(*keep, s.alias("_s")).select(*keep, "_s.variable", "_s.value")


def quantile_edge_table(base_long: DataFrame, bins: int = 10) -> DataFrame:
    """Per variable: sorted distinct exact quantile edges of the base population.

    The result has at most (bins + 1) numbers per variable of a declared column list, so
    it is collected once and re-created as a local table: the later joins then reuse it
    instead of re-running the quantile job for every reference."""
    q = exact_quantiles(base_long, "value", [i / bins for i in range(bins + 1)], by=["variable"])
    e = q.groupBy("variable").agg(F.array_sort(F.collect_set("value")).alias("edges"))
    spark = base_long.sparkSession
    return spark.createDataFrame(e.collect(), "variable string, edges array<double>")


def _bin_case(edge_rows) -> Column:
    """Bin index per variable as one literal CASE (right-closed bins, ends open):
    the number of inner edges strictly below the value. Plain comparisons stay in
    whole-stage codegen, unlike a lambda over an edge array."""
    outer = None
    for row in edge_rows:
        inner = list(row["edges"])[1:-1]
        e = None
        for i, edge in enumerate(inner):
            cond = F.col("value") <= F.lit(float(edge))
            e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
        e = F.lit(len(inner)) if e is None else e.otherwise(F.lit(len(inner)))
        c = F.col("variable") == F.lit(row["variable"])
        outer = F.when(c, e) if outer is None else outer.when(c, e)
    return outer


def psi_from_edges(base_long: DataFrame, other_long: DataFrame, edges: DataFrame) -> DataFrame:
    """Σ (pa − pb)·ln(pa / pb) over all bins; shares over non-null rows, empty bins
    floored at 1e-6 (no re-normalisation); fewer than 3 edges → NULL.

    The edge table (≤ bins + 1 numbers per variable of a declared column list) is read
    once on the driver and turned into a literal bin expression. Both populations then
    go through ONE pass — a flagged union and one grouped count per (variable,
    population, bin); the totals come from that small count table."""
    spark = base_long.sparkSession
    rows = [r for r in edges.collect() if r["edges"] is not None and len(r["edges"]) >= 3]
    names = [r["variable"] for r in rows]
    if not rows:
        return edges.select("variable").withColumn("psi", F.lit(None).cast("double"))
    u = (base_long.select("variable", "value", F.lit(0).alias("_pop"))
         .unionByName(other_long.select("variable", "value", F.lit(1).alias("_pop"))))
    x = u.where(F.col("value").isNotNull() & F.col("variable").isin(*names))
    c = x.groupBy("variable", "_pop", _bin_case(rows).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    t = c.groupBy("variable", "_pop").agg(F.sum("_n").alias("_t"))
    sh = (c.join(t, ["variable", "_pop"]).groupBy("variable", "bin")
          .agg(F.max(F.when(F.col("_pop") == 0, F.col("_n") / F.col("_t"))).alias("pa"),
               F.max(F.when(F.col("_pop") == 1, F.col("_n") / F.col("_t"))).alias("pb")))
    all_bins = spark.createDataFrame([(r["variable"], i) for r in rows for i in range(len(r["edges"]) - 1)],
                                     "variable string, bin int")
    j = all_bins.join(sh, ["variable", "bin"], "left")
    pa = F.when(F.coalesce("pa", F.lit(0.0)) == 0, F.lit(PSI_FLOOR)).otherwise(F.col("pa"))
    pb = F.when(F.coalesce("pb", F.lit(0.0)) == 0, F.lit(PSI_FLOOR)).otherwise(F.col("pb"))
    psi = j.groupBy("variable").agg(F.sum((pa - pb) * F.log(pa / pb)).alias("psi"))
    return edges.select("variable").join(psi, "variable", "left")


def psi_quantile(base: DataFrame, other: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """PSI with quantile cuts of the base population, every variable in one job."""
    a, b = to_long(base, cols), to_long(other, cols)
    return psi_from_edges(a, b, quantile_edge_table(a, bins))


def psi_fixed(base: DataFrame, other: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """D3: aligned share table on fixed right-closed edges (outside → dropped from the
    denominator), difference, and the PSI of the table on every row."""
    spark = base.sparkSession
    nb = len(edges) - 1

    def shares(df, name):
        v = F.col(col)
        inside = df.where((v > F.lit(float(edges[0]))) & (v <= F.lit(float(edges[-1]))))
        b = count_below(v, list(edges)[1:-1])
        c = inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
        t = inside.agg(F.count(F.lit(1)).alias("_t"))
        return with_totals(c, t).select("bin", (F.col("_n") / F.col("_t")).alias(name))

    bins = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    j = (bins.join(shares(base, "hist"), "bin", "left").join(shares(other, "pred"), "bin", "left")
         .fillna(0.0, ["hist", "pred"]).withColumn("dif", F.col("pred") - F.col("hist")))
    aa = F.when(F.col("hist") == 0, F.lit(PSI_FLOOR)).otherwise(F.col("hist"))
    bb = F.when(F.col("pred") == 0, F.lit(PSI_FLOOR)).otherwise(F.col("pred"))
    psi = j.agg(F.sum((bb - aa) * F.log(bb / aa)).alias("psi"))
    return with_totals(j, psi)


def drift_table(base: DataFrame, other: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Per variable mean / median / min / max in both populations plus PSI.

    One distributed exact-quantile pass over both populations yields the medians of both
    and the base population's PSI edges (the median is one of the decile edges). Each population is read
    once, into a narrow table below the shared folder."""
    base, other = materialize(base.select(*cols)), materialize(other.select(*cols))
    a = to_long(base, cols).withColumn("pop", F.lit("hist"))
    b = to_long(other, cols).withColumn("pop", F.lit("pred"))
    both = a.unionByName(b)
    st = both.groupBy("variable", "pop").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    qs = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(both, "value", sorted(set(qs) | {0.5}), by=["variable", "pop"])
    ql = base.sparkSession.createDataFrame(q.collect(), "variable string, pop string, q double, value double")  # ≤ vars × 2 × 12
    med = ql.where(F.col("q") == 0.5).select("variable", "pop", F.col("value").alias("median"))
    edges = (ql.where((F.col("pop") == "hist") & F.col("q").isin(*qs)).groupBy("variable")
             .agg(F.array_sort(F.collect_set("value")).alias("edges")))
    st = st.join(med, ["variable", "pop"], "left")
    wide = st.groupBy("variable").agg(*[F.max(F.when(F.col("pop") == p, F.col(m))).alias(f"{m}_{p}")
                                        for p in ("hist", "pred") for m in ("mean", "median", "min", "max")])
    psi = psi_from_edges(a.drop("pop"), b.drop("pop"), edges)
    return wide.join(psi, "variable", "left")


def ks_two_sample(a: DataFrame, b: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Max |F_a − F_b| of the two empirical CDFs, from counts by distinct value with
    running totals (distributed order, G0)."""
    u = (a.select(*by, F.col(col).alias("_v"), F.lit(1).alias("_fa"))
         .unionByName(b.select(*by, F.col(col).alias("_v"), F.lit(0).alias("_fa"))))
    st = score_table(u, "_v", "_fa", by=by)
    tot = (st.groupBy(*by) if by else st).agg(F.sum("pos").alias("_A"), F.sum("neg").alias("_B"))
    j = st.join(tot, list(by)) if by else with_totals(st, tot)
    d = F.abs(F.try_divide(F.col("pos_before") + F.col("pos"), F.col("_A")) - F.try_divide(F.col("neg_before") + F.col("neg"), F.col("_B")))
    return (j.groupBy(*by) if by else j).agg(F.max(d).alias("ks"))


def univariate_auc(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """AUC of each numeric variable against the label, nulls → the variable's median,
    folded to ≥ 0.5 with the direction sign."""
    lng = to_long(df, cols, keep=[label])
    med = exact_quantiles(lng, "value", [0.5], by=["variable"]).select("variable", F.col("value").alias("_med"))
    filled = lng.join(F.broadcast(med), "variable").withColumn("value", F.coalesce("value", "_med"))   # one row per variable
    a = auc_roc(filled, "value", label, by=["variable"])
    return a.select("variable", F.greatest("auc_roc", 1 - F.col("auc_roc")).alias("auc"),
                    F.when(F.col("auc_roc") > 0.5, "+").otherwise("-").alias("direction"))


def target_rate_auc(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Each category encoded by its own target rate, then AUC (optimistic by design)."""
    lng = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
                                             for c in cols])).alias("_s")).select(label, "_s.variable", "_s.level")
    lv = lng.where(F.col("level").isNotNull()).groupBy("variable", "level").agg(
        F.avg(label).alias("value"), F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    # levels, not rows, are ordered: equal rates are one score
    d = materialize(lv.groupBy("variable", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    a = auc_of_table(ordered_cumulative(d, "value", ["pos", "neg"], by=["variable"]), by=["variable"])
    return a.select("variable", F.greatest("auc_roc", 1 - F.col("auc_roc")).alias("auc"), F.lit("cat").alias("direction"))


def range_leak(df: DataFrame, key: str, label: str) -> DataFrame:
    """Key range per class, disjointness, accuracy of the rule ``key <= max key of
    class 1 → class 1``."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))
    cut = df.agg(F.max(F.when(F.col(label) == 1, F.col(key))).alias("cut"),
                 F.min(F.when(F.col(label) == 0, F.col(key))).alias("_min0"))
    acc = with_totals(df, cut.select("cut")).agg(
        F.avg(((F.col(key) <= F.col("cut")).cast("int") == F.col(label)).cast("double")).alias("rule_accuracy"))
    summary = cut.select("cut", (F.col("cut") < F.col("_min0")).alias("disjoint")).crossJoin(acc)
    return with_totals(g, summary)


def conflict_groups(df: DataFrame, feats: Sequence[str], outcome: str) -> DataFrame:
    """Identical feature vectors (nulls grouped together) with more than one outcome."""
    g = df.groupBy(*feats).agg(F.countDistinct(outcome).alias("_k"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("_k") > 1).alias("n_conflict"))


def coverage(base: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per categorical, level counts on both sides, levels new in ``other`` and the
    share of ``other`` rows whose level exists in ``base``. Both sides are counted by level before they meet."""
    from .profile import _level_counts, coverage_of_levels
    return coverage_of_levels(_level_counts(base, cols), _level_counts(other, cols))
