"""Feature contract (P11, P12) with explicit fit / apply.

Group means are *fitted* on one population and *applied* to another; an unseen group
falls back to the global mean of the population being scored. The fitted state is a
small DataFrame (one row per group level), never a driver-side dict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import scalar as S

STAGE_ORDER = {"M1": 1, "M2": 2, "M3": 3}   # fixed values: ordered stage labels

CATEGORICAL = ["region", "branch", "product", "credit_type", "sex", "stage"]
NUMERIC = ["nominal_rate", "granted", "balance", "prior_credits", "ratio_balance", "log_granted",
           "log_balance", "granted_per_credit", "balance_per_credit", "rate_rel_product",
           "ratio_x_credits", "stage_num", "zero_balance", "high_ratio"]


def with_totals(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row. The right side is a single row by
    construction (a global ``agg``), so broadcasting it is always bounded."""
    return df.crossJoin(F.broadcast(one_row))


#: Rows of a fitted table that may be broadcast.
FITTED_ROWS = 100_000


def join_fitted(df: DataFrame, fitted: DataFrame, on: str) -> DataFrame:
    """Rows with the fitted values of their level (left join). The fitted table is built once and counted: up to
    ``FITTED_ROWS`` levels are broadcast, so a level with a third of all rows stays where its rows are; a larger
    table is joined by shuffle, where AQE splits skewed levels."""
    fitted = materialize(fitted)
    small = fitted.limit(FITTED_ROWS + 1).count() <= FITTED_ROWS
    return df.join(F.broadcast(fitted) if small else fitted, on, "left")


def fit_group_means(df: DataFrame, group: str, value: str, name: str = "group_mean") -> DataFrame:
    """P11 fit: mean of ``value`` per non-null ``group`` level (pandas groupby drops null keys)."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.avg(value).alias(name)))


def apply_group_means(df: DataFrame, means: DataFrame, group: str, value: str, out: str,
                      name: str = "group_mean") -> DataFrame:
    """P11 apply: value − fitted mean of its group, unseen group → global mean of ``df``.

    The fitted table has one row per group level (``join_fitted``)."""
    glob = df.agg(F.avg(value).alias("_global_mean"))
    return (with_totals(join_fitted(df, means, group), glob)
            .withColumn(out, F.col(value) - F.coalesce(F.col(name), F.col("_global_mean")))
            .drop(name, "_global_mean"))


def clean(df: DataFrame) -> DataFrame:
    """Text clean-up of the categorical columns (P3) and integer credit count."""
    return (df.withColumn("credit_type", S.clean_category("credit_type", missing=None))
            .withColumn("sex", S.clean_category("sex", missing="ND"))
            .withColumn("stage", S.clean_category("stage", missing=None))
            .withColumn("prior_credits", F.col("prior_credits").cast("long")))


def build_features(df: DataFrame, rate_means: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole feature contract. Returns (features, fitted product-rate means).

    Pass ``rate_means`` fitted on another population to *apply* instead of fit."""
    d = clean(df)
    if rate_means is None:
        rate_means = fit_group_means(d, "product", "nominal_rate", "rate_mean")
    ratio = S.ratio_clip("balance", "granted")
    d = (d.withColumn("ratio_balance", ratio)
         .withColumn("log_granted", S.log1p("granted"))
         .withColumn("log_balance", S.log1p("balance"))
         .withColumn("granted_per_credit", S.per_unit("granted", "prior_credits"))
         .withColumn("balance_per_credit", S.per_unit("balance", "prior_credits"))
         .withColumn("ratio_x_credits", F.col("ratio_balance") * F.col("prior_credits"))
         .withColumn("stage_num", S.ordinal_map("stage", STAGE_ORDER, default=1))
         .withColumn("zero_balance", S.flag(F.col("balance") <= 1))
         .withColumn("high_ratio", S.flag(F.col("ratio_balance") > 0.85)))
    d = apply_group_means(d, rate_means, "product", "nominal_rate", "rate_rel_product", "rate_mean")
    return d, rate_means
