"""Evaluation metrics (E1-E9). All ranking metrics share one distinct-score table with
running positive / negative counts (see :mod:`strata.operators.order`), so a metric is
one aggregate over that table — no per-row global sort, no binned approximation.
Undefined values (a single class, an empty table) come back as NULL instead of failing
a division."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import with_totals
from ..functions.scalar import count_below
from ..session import materialize
from .order import decile_of_rank, exact_quantiles, global_rank, score_table


def _totals(st: DataFrame, by: Sequence[str]):
    g = st.groupBy(*by) if by else st
    return g.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.sum("n").alias("_T"))


def auc_roc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC, ties count one half (``roc_auc_score``)."""
    return auc_of_table(score_table(df, score, label, by=by), by)


def auc_of_table(st: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E1 from a table with one row per distinct score: pos, neg and neg_before in ascending order."""
    part = st.select(*by, (F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_w"), "pos", "neg")
    return (part.groupBy(*by) if by else part).agg(
        F.try_divide(F.sum("_w"), F.sum("pos") * F.sum("neg")).alias("auc_roc"))


def _desc_table(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    st = score_table(df, score, label, by=by, descending=True)
    return (st.withColumn("tp", F.col("pos_before") + F.col("pos"))
            .withColumn("fp", F.col("neg_before") + F.col("neg")))


def avg_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Σ (R_i − R_{i−1})·P_i over distinct thresholds, descending (step-wise, as
    ``average_precision_score``; not the trapezoidal area)."""
    t = _desc_table(df, score, label, by)
    part = t.select(*by, (F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_w"), "pos")
    return (part.groupBy(*by) if by else part).agg(F.try_divide(F.sum("_w"), F.sum("pos")).alias("avg_precision"))


def ks_model(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """max(TPR − FPR) over thresholds, the origin included."""
    t = _desc_table(df, score, label, by)
    tot = t.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N")) if by else \
        t.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = t.join(tot, list(by)) if by else with_totals(t, tot)
    part = j.select(*by, (F.try_divide(F.col("tp"), F.col("_P")) - F.try_divide(F.col("fp"), F.col("_N"))).alias("_d"))
    return (part.groupBy(*by) if by else part).agg(F.greatest(F.max("_d"), F.lit(0.0)).alias("ks"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    """E4."""
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def top_fraction(df: DataFrame, score: str, label: str, key: str, frac: float) -> DataFrame:
    """Rows in the top ``floor(n·frac)`` by score (ties by key) flagged as ``_top``."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    rk = global_rank(df, score, key, descending=True, out="_rk")
    return with_totals(rk, n).withColumn("_top", F.col("_rk") <= F.floor(F.col("_n") * F.lit(frac)))


def lift_topk(df: DataFrame, score: str, label: str, key: str, k: int = 1) -> DataFrame:
    """E5: positive rate among the top k deciles ÷ overall rate."""
    t = top_fraction(df, score, label, key, 0.1 * k)
    return t.agg(F.try_divide(F.avg(F.when(F.col("_top"), F.col(label))), F.avg(label)).alias("lift"))


def capture_topk(df: DataFrame, score: str, label: str, key: str, frac: float = 0.2) -> DataFrame:
    """Share of all positives found in the top fraction."""
    t = top_fraction(df, score, label, key, frac)
    return t.agg(F.try_divide(F.sum(F.when(F.col("_top"), F.col(label))), F.sum(label)).alias("capture"))


def decile_table(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Per decile n, mean predicted, observed rate, positives, lift, cumulative capture %."""
    df = materialize(df.select(key, score, label))      # the input is read once
    n = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_rate"), F.sum(label).alias("_pos"))
    rk = with_totals(global_rank(df, score, key, descending=True, out="_rk"), n)
    d = rk.withColumn("decile", decile_of_rank("_rk", "_n"))
    g = d.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"),
                                F.avg(label).alias("observed"), F.sum(label).alias("positives"),
                                F.first("_rate").alias("_rate"), F.first("_pos").alias("_pos"))
    from pyspark.sql import Window
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)   # 10 rows
    return (g.withColumn("lift", F.try_divide(F.col("observed"), F.col("_rate")))
            .withColumn("cum_capture_pct", 100.0 * F.try_divide(F.sum("positives").over(w), F.col("_pos")))
            .drop("_rate", "_pos"))


def evaluate(df: DataFrame, score: str, label: str, key: str, name: str = "model") -> DataFrame:
    """One row with AUC-PR, AUC-ROC, KS, Brier, lift of decile 1 and capture of the
    top 20%. AUC, AP and KS share ONE descending distinct-score table; lift and capture
    share ONE global order; everything ends in a single one-row result. The input is read once, into a
    narrow table (key, score, label) below the shared folder."""
    df = materialize(df.select(key, score, label))
    t = _desc_table(df, score, label)
    tot = t.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = with_totals(t, tot)
    # negatives strictly below a score = N − (negatives at or above it)
    below = F.col("_N") - F.col("fp")
    curve = j.agg(
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("_P")).alias("auc_pr"),
        F.try_divide(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))), F.first("_P") * F.first("_N")).alias("auc_roc"),
        F.greatest(F.max(F.try_divide(F.col("tp"), F.col("_P")) - F.try_divide(F.col("fp"), F.col("_N"))), F.lit(0.0)).alias("ks"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    rk = with_totals(global_rank(df, score, key, descending=True, out="_rk"), n)
    top = rk.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"),
                 F.try_divide(F.avg(F.when(F.col("_rk") <= F.floor(F.col("_n") * 0.1), F.col(label))), F.avg(label)).alias("lift_decile_1"),
                 F.try_divide(F.sum(F.when(F.col("_rk") <= F.floor(F.col("_n") * 0.2), F.col(label))), F.sum(label)).alias("capture_top20"))
    return curve.crossJoin(top).select(F.lit(name).alias("model"), "auc_pr", "auc_roc", "ks", "brier",
                                       "lift_decile_1", "capture_top20")


def reliability_curve(df: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """Quantile-strategy calibration curve. Edges are exact quantiles at i/n_bins;
    a score's bin is the number of inner edges strictly below it; empty bins vanish."""
    qs = [i / n_bins for i in range(n_bins + 1)]
    # n_bins + 1 numbers: read once, used as literal edges
    edges = [r["value"] for r in exact_quantiles(df, score, qs).orderBy("q").collect()]
    b = df.withColumn("bin", count_below(score, edges[1:-1]))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"),
                                F.avg(label).alias("frac_pos"))
