"""Checked queries for validation, models, calibration (M*) and attribution (I*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FE
from ..functions import scalar as S
from ..operators import attribution as I
from ..operators import boosting as B
from ..operators import campaign as C
from ..operators import metrics as E
from ..operators import models as M
from ..operators import order as O
from .q_relational import SIG_COLS, SIG_SQL, sql_clean
from ..session import materialize
from .registry import query, r

CATS = ["region", "branch", "product", "credit_type", "sex", "stage"]
NUMS = FE.NUMERIC
BALANCE_FAMILY = ["balance", "log_balance", "balance_per_credit", "ratio_balance", "ratio_x_credits", "zero_balance", "high_ratio"]
SEED = 42
#: Sizes of the fitted models in the registered queries; the operators' own defaults are 400 trees and 700
#: rounds. Depth-wise boosting needs fewer, deeper-stepped rounds than a leaf-wise learner on these tables.
FOREST = dict(trees=100)
BOOST = dict(iters=40, depth=4, step=0.1)
#: Leaf-wise boosting: the operator's defaults are 700 rounds of 48 leaves without a depth limit; a tree takes as
#: many Spark jobs as it is deep.
LEAFWISE = B.Settings(rounds=30, step=0.1, max_depth=5)
WITHOUT_BALANCE = [c for c in NUMS if c not in BALANCE_FAMILY]


def modelable(fx, materialized: bool = False):
    """Group id of the raw attribute vector, feature contract on the whole portfolio,
    k ≥ 2 rows, split. Model fits read a checkpointed copy (lineage cut once, not
    recomputed by every iteration)."""
    p = (fx.stored() if materialized else fx).portfolio.withColumn("gid", S.row_signature(SIG_COLS))
    d, _ = FE.build_features(p)
    d = M.group_split(M.population_filter(d), "gid", SEED)
    if materialized:
        d = materialize(M.model_categoricals(d, CATS))
    return d


def train_folds(fx):
    tr = modelable(fx, True).where("split = 'train'")
    return materialize(M.balanced_weights(M.group_kfold(tr, "gid", "y", 5, SEED, buckets=64), "y"))


GID_SQL = SIG_SQL
SPLIT_SQL = ("CASE WHEN CAST(('0x' || substr(md5(CAST(gid AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) % 100 < 60 THEN 'train' "
             "WHEN CAST(('0x' || substr(md5(CAST(gid AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) % 100 < 80 THEN 'calib' ELSE 'test' END")


@query("population_filter", """
SELECT count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM portfolio WHERE prior_credits >= 2""")
def population_filter(fx):
    return M.population_filter(fx.portfolio).agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate"))


@query("group_split", f"""
WITH m AS (SELECT client_id, {GID_SQL} AS gid FROM portfolio WHERE prior_credits >= 2)
SELECT client_id, gid, {SPLIT_SQL} AS split FROM m""")
def group_split(fx):
    return modelable(fx).select("client_id", "gid", "split")


@query("group_kfold", f"""
WITH m AS (SELECT client_id, y, {GID_SQL} AS gid FROM portfolio WHERE prior_credits >= 2),
g AS (SELECT gid, count(*) AS n, sum(y) AS pos FROM m GROUP BY gid),
h AS (SELECT gid, CAST(2 * pos >= n AS INTEGER) AS stratum,
      CAST(('0x' || substr(md5(CAST(gid AS VARCHAR) || '|42'), 1, 12)) AS BIGINT) AS hh FROM g),
f AS (SELECT gid, CAST((row_number() OVER (PARTITION BY stratum, hh % 64 ORDER BY hh, gid) - 1 + hh % 64) % 5 AS INTEGER) AS fold FROM h)
SELECT client_id, fold FROM m JOIN f USING (gid)""")
def group_kfold(fx):
    d = modelable(fx)
    return M.group_kfold(d, "gid", "y", 5, SEED, buckets=64).select("client_id", "fold")


SEX_NULL = f"nullif({sql_clean('sex')}, 'ND')"


@query("impute", f"""
WITH b AS (SELECT {SEX_NULL} AS sex, nullif(balance, 0) AS balance FROM portfolio_base),
mode_ AS (SELECT sex AS m FROM b WHERE sex IS NOT NULL GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1),
med AS (SELECT median(balance) AS m FROM b)
SELECT client_id, coalesce({SEX_NULL}, (SELECT m FROM mode_)) AS sex, round(coalesce(nullif(balance, 0), (SELECT m FROM med)), 6) AS balance
FROM portfolio_active""")
def impute(fx):
    def prep(df):
        return df.select("client_id", F.when(S.clean_category("sex") != "ND", S.clean_category("sex")).alias("sex"),
                         F.when(F.col("balance") != 0, F.col("balance")).alias("balance"))
    fitted = M.fit_impute(prep(fx.portfolio_base), ["sex"], ["balance"])
    out = M.apply_impute(prep(fx.portfolio_active), fitted, ["sex", "balance"])
    return out.select("client_id", "sex", r("balance").alias("balance"))


@query("onehot_rare", """
WITH lv AS (SELECT branch, count(*) >= 50 AS keep FROM portfolio_base GROUP BY branch)
SELECT client_id, CASE WHEN keep THEN CAST(branch AS VARCHAR) WHEN NOT keep THEN 'infrequent' END AS branch_pooled
FROM portfolio_active LEFT JOIN lv USING (branch)""")
def onehot_rare(fx):
    lv = M.fit_rare_levels(fx.portfolio_base, "branch", 50)
    return M.pool_rare(fx.portfolio_active, lv, "branch", "branch_pooled").select("client_id", "branch_pooled")


@query("standardize", """
WITH p AS (SELECT avg(granted) AS gm, stddev_pop(granted) AS gs, avg(balance) AS bm, stddev_pop(balance) AS bs FROM portfolio_base)
SELECT client_id, round((granted - gm) / gs, 6) AS granted, round((balance - bm) / bs, 6) AS balance FROM portfolio_active, p""")
def standardize(fx):
    cols = ["granted", "balance"]
    prm = M.fit_standardize(fx.portfolio_base, cols)
    return M.standardize(fx.portfolio_active.select("client_id", *cols), prm, cols).select(
        "client_id", *[r(c).alias(c) for c in cols])


@query("business_rule", """
SELECT client_id, CASE WHEN least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5) < 0.15
  OR (CASE WHEN upper(stage) = 'M2' THEN 2 WHEN upper(stage) = 'M3' THEN 3 ELSE 1 END) >= 2 THEN 1.0 ELSE 0.0 END AS rule
FROM portfolio""")
def business_rule(fx):
    d, _ = FE.build_features(fx.portfolio)
    return d.select("client_id", M.business_rule().alias("rule"))


def _mid(col: str) -> str:
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0) / count(*) OVER ()"


@query("rank_ensemble", f"""
SELECT client_id, round(({_mid('p')} + {_mid('acctbal')} + {_mid('granted')}) / 3, 6) AS ensemble FROM scored""")
def rank_ensemble(fx):
    return M.rank_ensemble(fx.scored, ["p", "acctbal", "granted"]).select("client_id", r("ensemble").alias("ensemble"))


@query("calibrator_choice", f"""
WITH m AS (SELECT p, y, {GID_SQL} AS gid FROM scored WHERE prior_credits >= 2),
c AS (SELECT * FROM m WHERE {SPLIT_SQL} = 'calib')
SELECT round(avg((p - y) * (p - y)), 6) AS brier_raw, round(avg((p * p - y) * (p * p - y)), 6) AS brier_calibrated,
  CASE WHEN avg((p * p - y) * (p * p - y)) < avg((p - y) * (p - y)) THEN 'calibrated' ELSE 'raw' END AS choice FROM c""")
def calibrator_choice(fx):
    d = M.group_split(M.population_filter(fx.scored).withColumn("gid", S.row_signature(SIG_COLS)), "gid", SEED)
    c = d.where("split = 'calib'").withColumn("p2", F.col("p") * F.col("p"))
    res = M.calibrator_choice(c, "p", "p2", "y")
    return res.select(r("brier_raw").alias("brier_raw"), r("brier_calibrated").alias("brier_calibrated"), "choice")


# ------------------------------------------------------------------ rows-only model queries
@query("logistic")
def logistic(fx):
    d = modelable(fx, True)
    tr = M.balanced_weights(d.where("split = 'train'"), "y")
    m = M.logistic(CATS, NUMS)(tr)
    return M.positive_prob(m.transform(d.where("split = 'test'"))).select("client_id", r("score").alias("score"))


@query("random_forest")
def random_forest(fx):
    d = modelable(fx, True)
    tr = M.balanced_weights(d.where("split = 'train'"), "y")
    m = M.random_forest(CATS, NUMS, **FOREST)(tr)
    return M.positive_prob(m.transform(d.where("split = 'test'"))).select("client_id", r("score").alias("score"))


@query("gbt")
def gbt(fx):
    d = modelable(fx, True)
    m = M.gbt(CATS, NUMS, **BOOST)(d.where("split = 'train'"))
    return M.positive_prob(m.transform(d.where("split = 'test'"))).select("client_id", r("score").alias("score"))


@query("oof_predict")
def oof_predict(fx):
    tf = train_folds(fx)
    return M.oof_predict(tf, "fold", M.logistic(CATS, NUMS), ["client_id", "fold", "y"])


def boosted_folds(tf, variants):
    """(client_id, y, one column per variant): out-of-fold scores of leaf-wise boosting, all folds of all variants in the same passes."""
    return B.oof_scores(tf, CATS, variants, "client_id", "fold", 5, settings=LEAFWISE)


def _ladder(fx):
    tf = train_folds(fx)
    keep = ["client_id", "y"]
    rows = []
    rule = tf.withColumn("score", M.business_rule())
    rows.append(E.evaluate(rule, "score", "y", "client_id", "rule (train)"))
    lr = M.oof_predict(tf, "fold", M.logistic(CATS, NUMS), keep, out="lr")
    rf = M.oof_predict(tf, "fold", M.random_forest(CATS, NUMS, **FOREST), keep, out="rf")
    gb = boosted_folds(tf, {"gbt": NUMS, "ablation": WITHOUT_BALANCE})
    allp = materialize(lr.join(rf.drop("y"), "client_id").join(gb.drop("y"), "client_id"))
    ens = M.rank_ensemble(allp, ["lr", "rf", "gbt"])
    for name, df, col in [("logistic (oof)", allp, "lr"), ("random forest (oof)", allp, "rf"),
                          ("boosting (oof)", allp, "gbt"), ("rank ensemble", ens, "ensemble"),
                          ("boosting without balance family", allp, "ablation")]:
        rows.append(E.evaluate(df, col, "y", "client_id", name))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


@query("ablation")
def ablation(fx):
    tf = train_folds(fx)
    ab = materialize(boosted_folds(tf, {"score": WITHOUT_BALANCE}))
    return E.evaluate(ab, "score", "y", "client_id", "boosting without balance family")


@query("model_ladder")
def model_ladder(fx):
    return _ladder(fx)


def _calibration_frames(fx):
    d = modelable(fx, True)
    m = M.gbt(CATS, NUMS, **BOOST)(d.where("split = 'train'"))
    cal = M.positive_prob(m.transform(d.where("split = 'calib'")), "raw").select("client_id", "y", "raw")
    te = M.positive_prob(m.transform(d.where("split = 'test'")), "raw").select("client_id", "y", "raw")
    return cal, te


@query("isotonic")
def isotonic(fx):
    cal, te = _calibration_frames(fx)
    iso = M.fit_isotonic(cal, "raw", "y")
    return M.apply_isotonic(iso, te).select("client_id", r("raw").alias("raw"), r("calibrated").alias("calibrated"))


@query("isotonic_given", f"""
WITH m AS (SELECT client_id, p, y, {SPLIT_SQL.replace('gid', GID_SQL)} AS split FROM scored WHERE prior_credits >= 2),
d AS (SELECT p AS x, sum(y) AS s, count(*) AS w, row_number() OVER (ORDER BY p) AS i FROM m WHERE split = 'calib' GROUP BY p),
c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM d),
ab AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS mean FROM c a JOIN c b ON a.i <= b.i),
lo AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ab),
iso AS (SELECT c.x, max(lo.m) AS v FROM lo JOIN c ON c.i = lo.b GROUP BY c.x),
t AS (SELECT client_id, p, (SELECT max(x) FROM iso WHERE x <= p) AS x0, (SELECT min(x) FROM iso WHERE x >= p) AS x1 FROM m WHERE split = 'test')
SELECT client_id, round(p, 6) AS raw, round(CASE WHEN x0 IS NULL THEN u.v WHEN x1 IS NULL OR x0 = x1 THEN l.v
         ELSE l.v + (u.v - l.v) * (p - x0) / (x1 - x0) END, 6) AS calibrated
FROM t LEFT JOIN iso l ON l.x = x0 LEFT JOIN iso u ON u.x = x1""")
def isotonic_given(fx):
    """M15 on given scores: fitted on the calibration block, applied to the test block. The twin is the max-min
    form of isotonic regression with linear interpolation between fitted scores."""
    d = M.group_split(M.population_filter(fx.scored).withColumn("gid", S.row_signature(SIG_COLS)), "gid", SEED)
    iso = M.fit_isotonic(materialize(d.where("split = 'calib'").select("p", "y")), "p", "y")
    return M.apply_isotonic(iso, d.where("split = 'test'").select("client_id", "p")) \
        .select("client_id", r("p").alias("raw"), r("calibrated").alias("calibrated"))


@query("platt")
def platt(fx):
    cal, te = _calibration_frames(fx)
    pm = M.fit_platt(cal, "raw", "y")
    return M.apply_platt(pm, te).select("client_id", r("raw").alias("raw"), r("platt").alias("platt"))


@query("score_active")
def score_active(fx):
    """Fit on the base population's modelable rows, calibrate on their grouped out-of-fold scores, save and load
    model and calibrator as one pipeline (S7) in the shared checkpoint folder, score the active population with
    them (unseen levels kept)."""
    from ..session import scratch_path
    from ..sources.sinks import load_model, sink_model
    import uuid
    fx = fx.stored()
    base, rate_means = FE.build_features(fx.portfolio_base.withColumn("gid", S.row_signature(SIG_COLS)))
    base = materialize(M.model_categoricals(M.population_filter(base), CATS))
    folds = materialize(M.group_kfold(base, "gid", "y", 5, SEED, buckets=64))
    m = M.calibrated_pipeline(base, folds, M.gbt(CATS, NUMS, **BOOST), "fold", "y")
    path = sink_model(m, scratch_path(fx.spark, f"model-{uuid.uuid4().hex}"))
    act, _ = FE.build_features(fx.portfolio_active, rate_means)
    act = M.model_categoricals(act, CATS)
    return M.calibrated_prob(load_model(path).transform(act)).select("client_id", r("score").alias("score"))


@query("holdout_report")
def holdout_report(fx):
    """Rows-only: raw, isotonic and Platt scores of the boosted model on the test block, all metrics."""
    d = modelable(fx, True)
    m = M.gbt(CATS, NUMS, **BOOST)(d.where("split = 'train'"))
    cal, te = (M.positive_prob(m.transform(d.where(f"split = '{b}'")), "raw").select("client_id", "y", "raw") for b in ("calib", "test"))
    cal = materialize(cal)
    scored = materialize(M.apply_platt(M.fit_platt(cal, "raw", "y"), M.apply_isotonic(M.fit_isotonic(cal, "raw", "y"), te)))
    out = None
    for c in ("raw", "calibrated", "platt"):
        row = E.evaluate(scored, c, "y", "client_id", c)
        out = row if out is None else out.unionByName(row)
    return out


@query("score_chain")
def score_chain(fx):
    """Rows-only: the whole chain. Grouped out-of-fold scores of the labelled rows choose a calibrator, the model
    is refitted on all of them, the active rows are scored, calibrated and clipped, first-credit rows are shifted
    to the extrapolated rate, and the result is the decile table of the shifted probabilities."""
    p = fx.portfolio_base.withColumn("gid", S.row_signature(SIG_COLS))
    base, rate_means = FE.build_features(p)
    base = M.model_categoricals(M.population_filter(base), CATS)
    tr = materialize(M.balanced_weights(M.group_kfold(base, "gid", "y", 5, SEED, buckets=64), "y"))
    model, calibrate, _ = M.calibrated_model(tr, M.gbt(CATS, NUMS, **BOOST), "fold", "y", "client_id")
    fx = fx.stored()       # not before: subsampling goes by row order, which the labelled rows have from their own plan
    act, _ = FE.build_features(fx.portfolio_active, rate_means)
    scored = M.positive_prob(model.transform(M.model_categoricals(act, CATS)), "raw").select("client_id", "prior_credits", "granted", "raw")
    scored = materialize(calibrate(scored, "raw", "p").withColumn("p", F.least(F.greatest("p", F.lit(C.CLIP)), F.lit(1 - C.CLIP))))
    first = F.col("prior_credits") <= 1
    rate = C.logit_extrapolate(C.rate_curve(fx.portfolio_base, "prior_credits", "y")).first()["rate_at"]
    shifted = C.prior_shift(scored, "p", rate, where=first) if rate is not None and 0 < rate < 1 else scored
    x = O.with_deciles(shifted, "p", "client_id")
    return x.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p")).alias("p_mean"), r(F.sum("p")).alias("expected_losses"),
                                   r(F.sum("granted"), 2).alias("granted"))


@query("coefficients")
def coefficients(fx):
    d = modelable(fx, True)
    tr = M.balanced_weights(d.where("split = 'train'"), "y")
    m = M.logistic(CATS, NUMS)(tr)
    return I.coefficients(fx.spark, m, tr)


# ------------------------------------------------------------------ attribution on given contributions
@query("importance_table", """
WITH i AS (SELECT variable, avg(abs(contribution)) AS importance FROM contrib GROUP BY variable)
SELECT variable, round(importance, 6) AS importance, round(100 * importance / sum(importance) OVER (), 6) AS share_pct,
  round(100 * sum(importance) OVER (ORDER BY importance DESC, variable ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(importance) OVER (), 6) AS cum_pct
FROM i""")
def importance_table(fx):
    t = I.importance_table(fx.contrib)
    return t.select("variable", *[r(c).alias(c) for c in ["importance", "share_pct", "cum_pct"]])


@query("effect_direction", """
WITH c AS (SELECT variable, coalesce(CASE WHEN stddev_pop(value) = 0 OR stddev_pop(contribution) = 0 THEN 0 ELSE corr(value, contribution) END, 0) AS r FROM contrib GROUP BY variable)
SELECT variable, round(r, 6) AS corr, CASE WHEN r > 0.05 THEN 'up' WHEN r < -0.05 THEN 'down' ELSE 'non-monotone' END AS direction FROM c""")
def effect_direction(fx):
    return I.effect_direction(fx.contrib).select("variable", r("corr").alias("corr"), "direction")


@query("rank_stability", """
WITH f AS (SELECT fold, variable, avg(abs(contribution)) AS imp FROM contrib GROUP BY 1, 2),
rk AS (SELECT variable, rank() OVER (PARTITION BY fold ORDER BY imp DESC) + (count(*) OVER (PARTITION BY fold, imp) - 1) / 2.0 AS rnk FROM f)
SELECT variable, round(avg(rnk), 6) AS mean_rank, round(stddev_samp(rnk), 6) AS std_rank FROM rk GROUP BY variable""")
def rank_stability(fx):
    return I.rank_stability(fx.contrib).select("variable", r("mean_rank").alias("mean_rank"), r("std_rank").alias("std_rank"))


@query("dependence_points", """
WITH b AS (SELECT variable, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM contrib GROUP BY variable)
SELECT client_id, variable, value, round(contribution, 6) AS contribution FROM contrib JOIN b USING (variable)
WHERE value >= lo AND value <= hi""")
def dependence_points(fx):
    return I.dependence_points(fx.contrib).select("client_id", "variable", "value", r("contribution").alias("contribution"))


@query("top_overlap", """
WITH a AS (SELECT variable FROM contrib GROUP BY variable ORDER BY avg(abs(contribution)) DESC, variable LIMIT 3),
c AS (SELECT variable, abs(corr(value, y)) AS s FROM contrib JOIN portfolio USING (client_id) GROUP BY variable),
b AS (SELECT variable FROM c ORDER BY s DESC, variable LIMIT 4)
SELECT count(*) AS overlap, string_agg(variable, ',' ORDER BY variable) AS variables FROM (SELECT variable FROM a INTERSECT SELECT variable FROM b)""")
def top_overlap(fx):
    c = fx.contrib.join(fx.portfolio.select("client_id", "y"), "client_id")
    return I.top_overlap(fx.contrib, c, 3, 4)


@query("tree_attribution")
def tree_attribution(fx):
    """Rows-only: TreeSHAP contributions of a boosted model on the test split, summarised
    to the importance table (I1 → I2) over whole rows."""
    d = modelable(fx, True)
    m = M.gbt(CATS, NUMS, **BOOST)(d.where("split = 'train'"))
    c = I.tree_attribution(m, d.where("split = 'test'"), "client_id")
    return I.importance_table(c.withColumnRenamed("attribute", "variable")).select(
        "variable", r("importance").alias("importance"), r("share_pct").alias("share_pct"), r("cum_pct").alias("cum_pct"))


def _variable(attribute):
    """The variable of an assembled attribute: its own name, or the longest variable name before an underscore."""
    out = attribute
    for c in sorted([*CATS, *NUMS], key=len):      # the last match wins
        out = F.when((attribute == c) | attribute.startswith(f"{c}_"), F.lit(c)).otherwise(out)
    return out


@query("rank_stability_refit")
def rank_stability_refit(fx):
    """I5 with a model refitted per fold, attributed on 3,000 of its training rows."""
    tf = train_folds(fx)
    t = I.refit_stability(tf, "fold", "client_id", M.gbt(CATS, NUMS, **BOOST), variable_of=_variable)
    return t.select("variable", r("mean_rank").alias("mean_rank"), r("std_rank").alias("std_rank"))


@query("coefficient_overlap")
def coefficient_overlap(fx):
    """Top 6 variables of a boosted model's contributions against the top 10 logistic coefficients."""
    d = modelable(fx, True)
    tr = materialize(M.balanced_weights(d.where("split = 'train'"), "y"))
    c = I.tree_attribution(M.gbt(CATS, NUMS, **BOOST)(tr), d.where("split = 'test'"), "client_id")
    c = c.withColumn("variable", _variable(F.col("attribute"))).groupBy("client_id", "variable").agg(F.sum("contribution").alias("contribution"))
    return I.coefficient_overlap(c, I.coefficients(fx.spark, M.logistic(CATS, NUMS)(tr), tr), 6, 10, _variable)
