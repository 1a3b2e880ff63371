"""Validation, models and calibration (M1-M18) on MLlib.

Splits and folds are pure functions of a hashed group id and a seed, so they are
deterministic under any partitioning and re-computation, and equal attribute vectors
always land in the same split. Fitted state (imputation values, kept levels, scaling
parameters) is a small DataFrame, never a driver-side dict."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import join_fitted, with_totals
from ..functions.scalar import clip_range, row_signature
from .order import exact_quantiles, mid_rank, present
from ..session import gathered, materialize


def hash_int(c: Column, seed: int, hex_digits: int = 8) -> Column:
    """Deterministic non-negative integer from md5(text‖seed)."""
    h = F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("long")


def model_categoricals(df: DataFrame, cats: Sequence[str], blank: str = "(blank)") -> DataFrame:
    """Categorical columns as text for the indexers; an empty level gets a visible name
    (encoders cannot name an attribute with an empty string)."""
    for c in cats:
        t = F.col(c).cast("string")
        df = df.withColumn(c, F.when(t == "", F.lit(blank)).otherwise(t))
    return df


def population_filter(df: DataFrame, k: str = "prior_credits", min_k: int = 2) -> DataFrame:
    """M1: modelable rows (k ≥ min_k)."""
    return df.where(F.col(k) >= min_k)


def group_split(df: DataFrame, gid: str, seed: int = 42, train: int = 60, calib: int = 80) -> DataFrame:
    """M2: train / calib / test by hash bucket (0-99) of the group id: < train, < calib,
    rest. Same contract as a grouped random split (disjoint groups), not the same rows."""
    b = hash_int(F.col(gid), seed) % 100
    return df.withColumn("split", F.when(b < train, "train").when(b < calib, "calib").otherwise("test"))


def group_kfold(df: DataFrame, gid: str, label: str, k: int = 5, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """M3: grouped, class-balanced folds. Each group gets a stratum (majority class), a
    hashed order and a hash bucket; folds are dealt round-robin inside (stratum, bucket)
    with the bucket as offset, so no window holds a whole stratum."""
    g = df.groupBy(gid).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_pos"))
    h = hash_int(F.col(gid), seed, 12)
    g = (g.withColumn("_stratum", (2 * F.col("_pos") >= F.col("_n")).cast("int"))
         .withColumn("_h", h).withColumn("_b", F.col("_h") % buckets))
    w = Window.partitionBy("_stratum", "_b").orderBy("_h", gid)
    g = g.withColumn("fold", ((F.row_number().over(w) - 1 + F.col("_b")) % k).cast("int")).select(gid, "fold")
    return df.join(g, gid)


# ---------------------------------------------------------------- M4-M6
def fit_impute(train: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """M4 fit: most frequent level (ties → smallest) per category, exact median per number.
    Returns one row with one column per input column."""
    parts = []
    for c in cats:
        # one row per level, then the most frequent (ties → smallest level)
        m = (train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias(c)))
        parts.append(m)
    if nums:
        from .audit import to_long
        q = exact_quantiles(to_long(train, nums), "value", [0.5], by=["variable"])
        parts.append(q.groupBy().pivot("variable", list(nums)).agg(F.first("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def apply_impute(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M4 apply: missing → fitted value."""
    f = fitted.select(*[F.col(c).alias(f"_f_{c}") for c in cols])
    res = with_totals(df, f)
    for c in cols:
        res = res.withColumn(c, F.coalesce(F.col(c), F.col(f"_f_{c}").cast(df.schema[c].dataType)))
    return res.drop(*[f"_f_{c}" for c in cols])


def fit_rare_levels(train: DataFrame, col: str, min_frequency: int = 50) -> DataFrame:
    """M5 fit: every level seen in train with a flag whether it is kept (count ≥ min)."""
    return (train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
            .select(col, (F.col("_n") >= min_frequency).alias("_keep")))


def pool_rare(df: DataFrame, levels: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M5 apply: kept level → itself, rare level → 'infrequent', unseen → NULL (ignored by
    the encoder)."""
    out = out or col
    pooled = F.when(F.col("_keep"), F.col(col).cast("string")).when(~F.col("_keep"), F.lit("infrequent"))
    j = join_fitted(df, levels, col).withColumn("_pooled", pooled).drop("_keep")
    if out == col:
        return j.drop(col).withColumnRenamed("_pooled", col)
    return j.withColumnRenamed("_pooled", out)


def fit_standardize(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M6 fit: mean and population std (ddof = 0) per column, one row."""
    return train.agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def standardize(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M6 apply: (x − mean) / std; zero std → 0."""
    res = with_totals(df, params)
    for c in cols:
        res = res.withColumn(c, F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
                             .otherwise(F.lit(0.0)))
    return res.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "std")])


def business_rule(ratio: str = "ratio_balance", stage_num: str = "stage_num", ratio_max: float = 0.15) -> Column:
    """M7: rule score 1 when ratio < 0.15 or stage ≥ 2."""
    return ((F.col(ratio) < ratio_max) | (F.col(stage_num) >= 2)).cast("double")


# ---------------------------------------------------------------- M8-M11, M13
def balanced_weights(df: DataFrame, label: str, out: str = "w") -> DataFrame:
    """n / (2·n_class) per row (class_weight='balanced')."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(c), label).crossJoin(F.broadcast(n)) \
        .withColumn(out, F.col("_n") / (2.0 * F.col("_nc"))).drop("_nc", "_n")


def feature_stages(cats: Sequence[str], nums: Sequence[str], one_hot: bool) -> list:
    """Indexers for categories (unseen → extra index), and for linear models one-hot
    (sparse) plus standardised numbers; then one assembled ``features`` vector."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cats]
    cat_out = [f"{c}_ix" for c in cats]
    num_out = list(nums)
    if one_hot:
        from pyspark.ml.feature import StandardScaler
        stages.append(OneHotEncoder(inputCols=cat_out, outputCols=[f"{c}_oh" for c in cats], handleInvalid="keep"))
        cat_out = [f"{c}_oh" for c in cats]
        stages.append(VectorAssembler(inputCols=list(nums), outputCol="_num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True))
        num_out = ["_num_s"]
    stages.append(VectorAssembler(inputCols=cat_out + num_out, outputCol="features", handleInvalid="keep"))
    return stages


def _sql_text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def impute_stage(train: DataFrame, cats: Sequence[str], nums: Sequence[str], min_frequency: int = 50) -> SQLTransformer:
    """M4 + M5 as one savable pipeline stage fitted on ``train``: a missing number becomes the exact median, a
    missing category the most frequent level, and levels below ``min_frequency`` are pooled (unseen levels stay
    as they are, for the indexer's extra index). The stage holds medians and rare levels as literals: as many
    as the one-hot model has columns anyway."""
    nan_free = train.select(*cats, *[F.when(present(c), F.col(c).cast("double")).alias(c) for c in nums])
    fitted = fit_impute(nan_free, cats, nums).first()
    sets = []
    for c in nums:
        sets.append(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {float(fitted[c] or 0.0)!r}D) AS `{c}`")
    for c in cats:
        rare = [x[0] for x in fit_rare_levels(train, c, min_frequency).where("NOT _keep").select(F.col(c).cast("string")).collect()]
        value = f"coalesce(CAST(`{c}` AS STRING), {_sql_text(str(fitted[c]))})"
        pooled = f"CASE WHEN {value} IN ({', '.join(map(_sql_text, rare))}) THEN 'infrequent' ELSE {value} END" if rare else value
        sets.append(f"{pooled} AS `{c}`")
    others = ", ".join(f"`{c}`" for c in (*cats, *nums))
    return SQLTransformer(statement=f"SELECT * EXCEPT ({others}), {', '.join(sets)} FROM __THIS__")


def missing_stage(train: DataFrame, nums: Sequence[str]) -> SQLTransformer:
    """Missing numbers for trees: one below the smallest value seen, so that a split can set them apart."""
    low = train.agg(*[F.min(F.when(present(c), F.col(c).cast("double"))).alias(c) for c in nums]).first()
    sets = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {float(low[c] or 0.0) - 1.0!r}D) AS `{c}`" for c in nums)
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`{c}`' for c in nums)}), {sets} FROM __THIS__")


def logistic(cats, nums, weight: str | None = "w", reg: float | None = None) -> Callable[[DataFrame], PipelineModel]:
    """M8: L2 logistic on one-hot + standardised numbers, balanced class weights.
    regParam = 1 / Σw matches an inverse-strength C = 1 objective."""
    def fit(train: DataFrame) -> PipelineModel:
        train = gathered(train)
        sw = train.agg(F.sum(weight)).first()[0] if weight else train.count()
        lr = LogisticRegression(featuresCol="features", labelCol="y", regParam=reg if reg is not None else 1.0 / sw,
                                elasticNetParam=0.0, standardization=False, maxIter=100,
                                **({"weightCol": weight} if weight else {}))
        return Pipeline(stages=[impute_stage(train, cats, nums), *feature_stages(cats, nums, True), lr]).fit(train)
    return fit


def tree_bins(train: DataFrame, cats: Sequence[str], least: int = 64) -> int:
    """Bins that hold every level of every category plus the index of unseen levels."""
    if not cats:
        return least
    row = train.agg(*[F.countDistinct(c).alias(f"n{i}") for i, c in enumerate(cats)]).first()
    return max(least, max(row) + 2)


def random_forest(cats, nums, trees: int = 400, min_leaf: int = 15, weight: str | None = "w", seed: int = 42):
    """M9."""
    def fit(train: DataFrame) -> PipelineModel:
        train = gathered(train)
        rf = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, minInstancesPerNode=min_leaf,
                                    maxBins=tree_bins(train, cats), seed=seed, **({"weightCol": weight} if weight else {}))
        return Pipeline(stages=[impute_stage(train, cats, nums), *feature_stages(cats, nums, False), rf]).fit(train)
    return fit


def gbt(cats, nums, iters: int = 700, depth: int = 5, step: float = 0.05, subsample: float = 0.85, seed: int = 42):
    """Gradient-boosted trees (depth-wise; a quality target, not equal scores to a
    leaf-wise learner)."""
    def fit(train: DataFrame) -> PipelineModel:
        train = gathered(train)
        g = GBTClassifier(featuresCol="features", labelCol="y", maxIter=iters, maxDepth=depth, stepSize=step,
                          subsamplingRate=subsample, maxBins=tree_bins(train, cats), seed=seed)
        return Pipeline(stages=[missing_stage(train, nums), *feature_stages(cats, nums, False), g]).fit(train)
    return fit


def positive_prob(pred: DataFrame, out: str = "score") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def in_threads(spark: SparkSession, tasks: Sequence[Callable], at_once: int) -> list:
    """Results of driver-side tasks in their order, ``at_once`` of them running. Jobs of different threads share the
    cores: the short passes of one fit run while the driver works on another's. Each task gets its own copy of the
    session's local properties."""
    with ThreadPoolExecutor(at_once) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def _fold_tasks(df: DataFrame, fold: str, fit: Callable[[DataFrame], PipelineModel], keep: Sequence[str], k: int, out: str) -> list[Callable]:
    def part(f: int) -> DataFrame:
        m = fit(df.where(F.col(fold) != f))   # callers pass a materialized frame
        return positive_prob(m.transform(df.where(F.col(fold) == f)), out).select(*keep, out)
    return [lambda f=f: part(f) for f in range(k)]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def oof_predict(df: DataFrame, fold: str, fit: Callable[[DataFrame], PipelineModel], keep: Sequence[str],
                k: int = 5, out: str = "score") -> DataFrame:
    """Out-of-fold predictions: fit on the other folds, score the held-out fold,
    union. Each fit is a distributed MLlib job."""
    return _union([t() for t in _fold_tasks(df, fold, fit, keep, k, out)])


def rank_ensemble(df: DataFrame, scores: Sequence[str], out: str = "ensemble") -> DataFrame:
    """Mean of mid-ranks / n of several scores."""
    res = df
    for s in scores:
        res = mid_rank(res, s, out=f"_mr_{s}")
    return res.withColumn(out, sum(F.col(f"_mr_{s}") for s in scores) / len(scores)).drop(*[f"_mr_{s}" for s in scores])


# ---------------------------------------------------------------- M15-M17
def fit_isotonic(df: DataFrame, score: str, label: str):
    """Monotone calibration; MLlib interpolates and clamps outside the fitted range."""
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated", isotonic=True).fit(df)


def apply_isotonic(model, df: DataFrame, out: str = "calibrated") -> DataFrame:
    res = model.transform(df)
    return res.withColumn(out, F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))) if out == "calibrated" \
        else res.withColumnRenamed("calibrated", out)


def fit_platt(df: DataFrame, score: str, label: str):
    """One-feature logistic on the raw score (C = 1 → regParam = 1 / n)."""
    n = df.count()
    lr = LogisticRegression(featuresCol="_pf", labelCol=label, regParam=1.0 / n, standardization=False,
                            probabilityCol="_pp", rawPredictionCol="_pr", predictionCol="_pd")
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_pf"), lr]).fit(df)


def apply_platt(model, df: DataFrame, out: str = "platt") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("_pp")[1]).drop("_pf", "_pp", "_pr", "_pd")


def calibrator_choice(df: DataFrame, raw: str, calibrated: str, label: str) -> DataFrame:
    """Brier of raw vs calibrated score on the calibration block and the choice."""
    b = df.agg(F.avg(F.pow(F.col(raw) - F.col(label), 2)).alias("brier_raw"),
               F.avg(F.pow(F.col(calibrated) - F.col(label), 2)).alias("brier_calibrated"))
    return b.withColumn("choice", F.when(F.col("brier_calibrated") < F.col("brier_raw"), "calibrated").otherwise("raw"))


def signature(df: DataFrame, cols: Sequence[str], out: str = "gid") -> DataFrame:
    return df.withColumn(out, row_signature(cols))


# ---------------------------------------------------------------- the scoring chain
def calibrated_model(train: DataFrame, fit: Callable[[DataFrame], PipelineModel], fold: str, label: str, key: str, k: int = 5):
    """Out-of-fold scores of ``train`` (grouped folds), both calibrators fitted on them, the better one by Brier
    score, and a refit on all rows. Returns (model, calibrate, choice): ``calibrate(df, raw, out)`` adds the
    chosen calibration of a raw score."""
    oof = materialize(oof_predict(train, fold, fit, [key, label], k, out="raw"))
    iso, pl = fit_isotonic(oof, "raw", label), fit_platt(oof, "raw", label)
    both = apply_platt(pl, apply_isotonic(iso, oof))
    b = both.agg(*[F.avg(F.pow(F.col(c) - F.col(label), 2)).alias(c) for c in ("raw", "calibrated", "platt")]).first()
    choice = min(("raw", "calibrated", "platt"), key=lambda c: b[c])

    def calibrate(df: DataFrame, raw: str, out: str) -> DataFrame:
        x = df.withColumnRenamed(raw, "raw")
        x = apply_platt(pl, x, out) if choice == "platt" else apply_isotonic(iso, x, out) if choice == "calibrated" else x.withColumn(out, F.col("raw"))
        return x.withColumnRenamed("raw", raw)

    return fit(train), calibrate, choice


#: Fits that run at once in ``calibrated_pipeline``.
FITS_AT_ONCE = 3


def calibrated_pipeline(train: DataFrame, folds: DataFrame, fit: Callable[[DataFrame], PipelineModel], fold: str,
                        label: str, k: int = 5) -> PipelineModel:
    """One savable pipeline of the model fitted on all rows of ``train`` and its calibrator as last stage:
    isotonic regression on out-of-fold scores, which stays if it improves their Brier score. ``folds`` has the same
    rows with their fold (grouped). Rows that all lie in one fold have no out-of-fold scores, and the model no calibrator."""
    several = folds.select(fold).distinct().count() > 1
    tasks = _fold_tasks(folds, fold, fit, [label], k, "raw") if several else []
    model, *parts = in_threads(train.sparkSession, [lambda: fit(train), *tasks], FITS_AT_ONCE)
    if not parts:
        return model
    oof = materialize(_union(parts))
    iso = fit_isotonic(oof, "raw", label)
    if calibrator_choice(apply_isotonic(iso, oof), "raw", "calibrated", label).first()["choice"] != "calibrated":
        return model
    return PipelineModel([*model.stages, iso.setFeaturesCol("probability").setFeatureIndex(1)])


#: Calibrated scores are kept this far from 0 and 1.
SCORE_CLIP = 1e-4


def calibrated_prob(pred: DataFrame, out: str = "score") -> DataFrame:
    """The calibrated probability of rows that a ``calibrated_pipeline`` has transformed, kept off 0 and 1 (P16);
    the model's own probability if no calibrator stayed."""
    p = F.col("calibrated") if "calibrated" in pred.columns else vector_to_array("probability")[1]
    return pred.withColumn(out, clip_range(p, SCORE_CLIP, 1 - SCORE_CLIP))
