"""Risk, campaign and scenario operators.

Everything that orders clients (deciles, priorities, capacity cuts) uses the global
order helper (G0), so no step funnels the client table through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import with_totals
from ..functions.scalar import cut_bins
from .order import decile_of_rank, global_rank, present


@dataclass(frozen=True)
class Campaign:
    margin: float = 0.30          # net margin on the next cycle's interest income
    contact_cost: float = 25.0    # cost per contacted client
    effectiveness: float = 0.20   # share of predicted leavers a contact retains


# fixed values: risk segment edges and labels (right-closed)
RISK_EDGES = [-0.01, 0.20, 0.50, 1.01]
RISK_LABELS = ["Low", "Medium", "High"]


def rate_curve(df: DataFrame, k: str, label: str) -> DataFrame:
    """Empirical rate and n by number of credits."""
    return df.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))


def logit_extrapolate(curve: DataFrame, k: str = "prior_credits", lo: int = 2, hi: int = 5, at: float = 1.0) -> DataFrame:
    """Fit logit(rate) = a + b·ln k on k = lo..hi, evaluate at k = ``at``. A point with rate 0 or 1
    has no finite logit; ``points`` counts the points used and ``points_left_out`` those."""
    own = curve.where((F.col(k) >= lo) & (F.col(k) <= hi))
    usable = (F.col("rate") > 0) & (F.col("rate") < 1)
    x = F.when(usable, F.log(F.col(k).cast("double")))
    yl = F.when(usable, F.log(F.try_divide(F.col("rate"), 1 - F.col("rate"))))
    fit = own.select(x.alias("x"), yl.alias("yl")).agg(
        F.regr_intercept("yl", "x").alias("a"), F.regr_slope("yl", "x").alias("b"), F.count("yl").alias("points"),
        F.count_if(F.col("yl").isNull()).alias("points_left_out"))
    return fit.withColumn("rate_at", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.lit(math.log(at))))))


#: Scores are kept this far from 0 and 1 before a logit (an isotonic score may be exactly 0 or 1).
CLIP = 1e-6


def _logit(p):
    """Clipped logit of a score; NULL for a missing score (NULL or NaN)."""
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.when(present(p), F.log(q / (1 - q)))


def _expit_shift(p, c):
    return 1 / (1 + F.exp(-(_logit(p) + c)))


def prior_shift_constants(df: DataFrame, p: str, targets: Sequence[float], lo: float = -30.0, hi: float = 30.0,
                          candidates: int = 32, passes: int = 7) -> list[float]:
    """C3 search for any number of targets at once: per target the shift c in logit space with
    mean(expit(logit p + c)) = target, p clipped to [CLIP, 1 - CLIP]. NULL and NaN scores take no part;
    without any score there is nothing to shift and every c is 0. A target outside (0, 1), or beyond the
    search range, raises ValueError.

    The mean is monotone in c. Each pass evaluates ``candidates`` values of c per target in ONE aggregate over
    the distinct (p, count) table and keeps every target's bracketing pair: the driver sees ``candidates``
    numbers a target, and the number of passes does not depend on the targets; 7 passes narrow 60 to ~1e-9."""
    for t in targets:
        if not 0 < t < 1:
            raise ValueError(f"the target mean {t} is not between 0 and 1")
    if not targets:
        return []
    d = df.where(present(p)).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_w")) \
        .select(_logit(F.col("_p")).alias("_z"), "_w").cache()
    brackets = [(lo, hi)] * len(targets)
    ends: list[tuple[float, float, float, float]] = []
    try:
        for i in range(passes):
            # all brackets are the same in the first pass
            grids = [[x + (y - x) * j / (candidates - 1) for j in range(candidates)] for x, y in (brackets if i else brackets[:1])]
            flat = F.array(*[F.lit(c) for g in grids for c in g])
            rows = d.select("_z", "_w", F.posexplode(flat).alias("j", "c")).groupBy("j") \
                .agg((F.sum(F.col("_w") / (1 + F.exp(-(F.col("_z") + F.col("c"))))) / F.sum("_w")).alias("m")).collect()
            if not rows:
                return [0.0] * len(targets)
            found = {r["j"]: r["m"] for r in rows}
            ends = []
            for k, t in enumerate(targets):
                base = k if i else 0
                cs, means = grids[base], [found[base * candidates + j] for j in range(candidates)]
                if i == 0 and not means[0] <= t <= means[-1]:
                    raise ValueError(f"no shift in [{lo}, {hi}] gives the target mean {t}")
                j = next((j for j in range(1, candidates) if means[j] >= t), candidates - 1)
                ends.append((cs[j - 1], cs[j], means[j - 1], means[j]))
            brackets = [(x, y) for x, y, _, _ in ends]
    finally:
        d.unpersist()
    return [(x + y) / 2 if my == mx else x + (t - mx) * (y - x) / (my - mx) for t, (x, y, mx, my) in zip(targets, ends, strict=True)]


def prior_shift_constant(df: DataFrame, p: str, target: float, lo: float = -30.0, hi: float = 30.0) -> float:
    """C3 search for one target (see ``prior_shift_constants``)."""
    return prior_shift_constants(df, p, [target], lo, hi)[0]


def prior_sensitivity(df: DataFrame, p: str, key: str, where, targets: Sequence[float], tops: Sequence[int]) -> DataFrame:
    """C4: per target mean of the rows selected by ``where``: mean and sum of all scores after the shift, and
    for each K of ``tops`` how many selected rows stand among the K highest (ties by key, missing scores last).

    One search serves all targets. The shift keeps the order of the selected rows and leaves the others as they
    are, so the K highest of any target are among the K highest of either side: 2 x max(K) rows, found once,
    are ranked per target. The sums are one aggregate, combined before the shuffle."""
    cs = prior_shift_constants(df.where(where), p, targets)
    shifts = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.lit(c).alias("c")) for t, c in zip(targets, cs, strict=True)])).alias("_s")
    x = df.select(F.col(key).alias("_key"), F.col(p).alias("_p"), F.coalesce(where, F.lit(False)).alias("_in"))
    after = F.when(F.col("_in"), _expit_shift(F.col("_p"), F.col("_s.c"))).otherwise(F.when(present("_p"), F.col("_p")))
    sums = x.select("_p", "_in", shifts).groupBy(F.col("_s.target").alias("target")).agg(F.avg(after).alias("p_mean"), F.sum(after).alias("expected_losses"))
    order = F.when(F.col("_in"), _logit(F.col("_p"))).otherwise(F.col("_p"))
    order = F.when(present("_p"), order).desc_nulls_last()      # missing scores last
    high = [x.where(side).orderBy(order, F.col("_key").asc_nulls_last()).limit(max(tops)) for side in (F.col("_in"), ~F.col("_in"))]
    w = Window.partitionBy("_s.target").orderBy(after.desc_nulls_last(), F.col("_key").asc_nulls_last())     # 2 x max(tops) rows a target
    ranked = high[0].unionByName(high[1]).select("*", shifts).withColumn("_rk", F.row_number().over(w))
    counts = ranked.groupBy(F.col("_s.target").alias("target")).agg(
        *[F.count_if(F.col("_in") & (F.col("_rk") <= k)).alias(f"segment_in_top{k}") for k in tops])
    return sums.join(counts, "target")


def prior_shift(df: DataFrame, p: str, target: float, out: str | None = None, where=None) -> DataFrame:
    """Shift p of the rows selected by ``where`` (all if None) so their mean hits the
    target; order is kept because the map is monotone. A missing score (NULL or NaN) becomes NULL."""
    sel = df.where(where) if where is not None else df
    c = prior_shift_constant(sel, p, target)
    shifted = _expit_shift(F.col(p), F.lit(c))
    col = F.when(where, shifted).otherwise(F.col(p)) if where is not None else shifted
    return df.withColumn(out or p, col)


def risk_segment(p: str = "p"):
    """Low ≤ 0.20 < Medium ≤ 0.50 < High (right-closed)."""
    return cut_bins(p, RISK_EDGES, RISK_LABELS)


def risk_decile_table(df: DataFrame, p: str, key: str, balance: str, k: str, extra=()) -> DataFrame:
    """Decile (1 = highest risk): n, mean/min/max p, expected losses, balance at risk,
    share of first credits, cumulative capture %, lift (plus optional extra aggregates)."""
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_mp"), F.sum(p).alias("_sp"))
    rk = with_totals(global_rank(df, p, key, descending=True, out="_rk"), tot)
    d = rk.withColumn("decile", decile_of_rank("_rk", "_n"))
    g = d.groupBy("decile").agg(
        F.count(F.lit(1)).alias("clients"), F.avg(p).alias("p_mean"), F.min(p).alias("p_min"), F.max(p).alias("p_max"),
        F.sum(p).alias("expected_losses"), F.sum(balance).alias("balance_at_risk"),
        F.avg((F.col(k) == 1).cast("double")).alias("share_first_credit"),
        F.first("_mp").alias("_mp"), F.first("_sp").alias("_sp"), *extra)
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)   # ten rows
    return (g.withColumn("cum_capture_pct", 100.0 * F.try_divide(F.sum("expected_losses").over(w), F.col("_sp")))
            .withColumn("lift", F.try_divide(F.col("p_mean"), F.col("_mp"))).drop("_mp", "_sp"))


def segment_table(df: DataFrame, p: str, balance: str) -> DataFrame:
    """Risk segment totals with their share of the portfolio balance."""
    g = df.groupBy(risk_segment(p).alias("segment")).agg(
        F.count(F.lit(1)).alias("clients"), F.avg(p).alias("p_mean"), F.sum(p).alias("expected_losses"),
        F.sum(balance).alias("balance"))
    tot = g.agg(F.sum("balance").alias("_t"))
    return with_totals(g, tot).withColumn("portfolio_pct", 100.0 * F.try_divide(F.col("balance"), F.col("_t"))).drop("_t")


def expected_value(df: DataFrame, p: str, capital: str, rate: str, key: str, cfg: Campaign = Campaign(),
                   priority: bool = True) -> DataFrame:
    """Client value, expected benefit of a contact, recommendation and (optionally)
    the priority rank by benefit."""
    d = (df.withColumn("client_value", F.col(capital) * F.col(rate) / 100.0 * F.lit(cfg.margin))
         .withColumn("expected_benefit", F.col(p) * F.lit(cfg.effectiveness) * F.col("client_value") - F.lit(cfg.contact_cost))
         .withColumn("recommend", F.when(F.col("expected_benefit") > 0, "Yes").otherwise("No")))
    return global_rank(d, "expected_benefit", key, descending=True, out="priority") if priority else d


def campaign_scenarios(df: DataFrame, p: str, value: str, effs: Sequence[float], cost: float) -> DataFrame:
    """Per effectiveness: selected clients, share, losses covered, retentions, cost,
    benefit and ROI (NULL when nobody is selected).

    One pass over the rows: every scenario is a set of conditional sums in the same
    aggregate (no row is copied per scenario); the one-row result is then unpivoted."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_sp")]
    for i, e in enumerate(effs):
        b = F.col(p) * F.lit(float(e)) * F.col(value) - F.lit(cost)
        sel = b > 0
        aggs += [F.count_if(sel).alias(f"s{i}"),
                 F.coalesce(F.sum(F.when(sel, F.col(p))), F.lit(0.0)).alias(f"l{i}"),
                 F.coalesce(F.sum(F.when(sel, b)), F.lit(0.0)).alias(f"b{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("effectiveness"), F.col(f"s{i}").alias("selected"),
                                        F.col(f"l{i}").alias("losses_covered"), F.col(f"b{i}").alias("benefit"))
                               for i, e in enumerate(effs)]))
    g = one.select("_n", "_sp", rows.alias("_r")).select("_n", "_sp", "_r.*")
    return (g.withColumn("retentions", F.col("losses_covered") * F.col("effectiveness"))
            .withColumn("share_selected", F.try_divide(F.col("selected"), F.col("_n")))
            .withColumn("share_losses", F.try_divide(F.col("losses_covered"), F.col("_sp")))
            .withColumn("cost", F.col("selected") * F.lit(cost))
            .withColumn("roi", F.when(F.col("selected") > 0, F.col("benefit") / F.col("cost")))
            .drop("_n", "_sp"))


def campaign_capacity(df: DataFrame, p: str, key: str, balance: str, capacities: Sequence[int],
                      cfg: Campaign = Campaign()) -> DataFrame:
    """For each capacity K the K clients with the highest expected benefit (ties by
    key): mean p, losses, share of losses, retentions, balance, cost K·c, benefit."""
    ranked = global_rank(df, "expected_benefit", key, descending=True, out="_rk")
    tot = df.agg(F.sum(p).alias("_sp"))
    ks = df.sparkSession.createDataFrame([(int(k),) for k in capacities], "capacity long")
    sel = (ranked.where(F.col("_rk") <= max(capacities)).crossJoin(F.broadcast(ks))
           .where(F.col("_rk") <= F.col("capacity")))
    g = sel.groupBy("capacity").agg(F.avg(p).alias("p_mean"), F.sum(p).alias("expected_losses"),
                                    F.sum(F.col(p) * F.lit(cfg.effectiveness)).alias("retentions"),
                                    F.sum(balance).alias("balance_protected"), F.sum("expected_benefit").alias("benefit"))
    return (with_totals(g, tot).withColumn("share_losses", F.try_divide(F.col("expected_losses"), F.col("_sp")))
            .withColumn("cost", F.col("capacity") * F.lit(cfg.contact_cost)).drop("_sp"))


def campaign_grid(df: DataFrame, p: str, value: str, key: str, balance: str, effs: Sequence[float],
                  costs: Sequence[float], capacities: Sequence[int]) -> DataFrame:
    """C11: free grid effectiveness × cost × capacity.

    For fixed (effectiveness, cost) the benefit p·e·v − c orders clients exactly like
    p·v, so ONE global order (G0) with running sums serves every scenario: a scenario
    selects the prefix of length m = min(K, #{p·v > c/e}), and its totals are the
    running sums at rank m — an equi-join of the scenario table on the rank."""
    spark = df.sparkSession
    d = df.withColumn("_pv", F.col(p) * F.col(value))
    ranked = global_rank(d, "_pv", key, descending=True, out="_rk",
                         running={"_cp": F.col(p), "_cpv": F.col("_pv"), "_cb": F.col(balance)})
    grid = spark.createDataFrame([(float(e), float(c), int(k)) for e in effs for c in costs for k in capacities],
                                 "effectiveness double, cost double, capacity long")
    thr = sorted({(float(c) / float(e)) for e in effs for c in costs})
    counts = d.agg(*[F.count_if(F.col("_pv") > F.lit(t)).alias(f"t{i}") for i, t in enumerate(thr)]).first()
    npos = spark.createDataFrame([(t, int(counts[f"t{i}"])) for i, t in enumerate(thr)], "thr double, n_pos long")
    g = (grid.withColumn("thr", F.col("cost") / F.col("effectiveness")).join(F.broadcast(npos), "thr")
         .withColumn("m", F.least(F.col("capacity"), F.col("n_pos"))))
    at = ranked.select("_rk", "_cp", "_cpv", "_cb")
    j = g.join(at, g.m == at._rk, "left")
    return j.select("effectiveness", "cost", "capacity", F.col("m").alias("selected"),
                    F.coalesce("_cp", F.lit(0.0)).alias("expected_losses"),
                    (F.col("effectiveness") * F.coalesce("_cp", F.lit(0.0))).alias("retentions"),
                    F.coalesce("_cb", F.lit(0.0)).alias("balance"),
                    (F.col("effectiveness") * F.coalesce("_cpv", F.lit(0.0)) - F.col("cost") * F.col("m")).alias("benefit"))


def kpi_row(scored: DataFrame, p: str, balance: str) -> DataFrame:
    """One-row KPI set of a scored portfolio."""
    seg = risk_segment(p)
    return scored.agg(F.count(F.lit(1)).alias("clients"), F.avg(p).alias("p_mean"), F.sum(p).alias("expected_losses"),
                      F.count_if(seg == "High").alias("high_risk"), F.sum(balance).alias("balance_total"),
                      F.sum(F.when(seg == "High", F.col(balance))).alias("balance_high_risk"),
                      F.count_if(F.col("recommend") == "Yes").alias("campaign"))
