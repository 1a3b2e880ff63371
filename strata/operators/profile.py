"""Stored population profiles: what drift (D1), PSI (D2) and coverage (D12) need of the base population, so that
its rows are read once and later populations are compared with a few stored rows. Also the column dictionary (A4)
and the level report (P4)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import sinks
from .audit import PSI_FLOOR, _bin_case, to_long
from .order import exact_quantiles, present

EDGES = "variable string, edges array<double>, median double"
NUMERIC = ("variable string, rows long, n long, total double, low double, high double, median double, exact boolean, "
           "edges array<double>, counts array<bigint>, sketch binary")


@dataclass(frozen=True)
class Profile:
    """``numeric``: one row per variable (variable, rows, n, total, low, high, median, exact, edges, counts, sketch);
    ``counts`` are the non-null values per bin, ``sketch`` a mergeable quantile sketch. ``levels``: one row per
    (variable, level, n), missing values as the NULL level."""
    numeric: DataFrame
    levels: DataFrame


def _level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per (variable, level), counted map-side before the shuffle; the NULL level counts missing values."""
    if not cols:
        return df.sparkSession.createDataFrame([], "variable string, level string, n long")
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols]))
    return df.select(s.alias("_s")).groupBy("_s.variable", "_s.level").agg(F.count(F.lit(1)).alias("n"))


def _counted(df: DataFrame, edges: DataFrame) -> DataFrame:
    """One pass over the rows: statistics, bin counts and sketch of every variable, on given edges. ``edges`` has one
    short row per declared variable and becomes a literal expression."""
    rows = edges.collect()
    if not rows:
        return df.sparkSession.createDataFrame([], NUMERIC)
    cut = [r for r in rows if r["edges"] is not None and len(r["edges"]) >= 3]
    v = F.col("value")
    case = F.when(v.isNotNull(), _bin_case(cut)) if cut else F.lit(None).cast("int")
    per_bin = to_long(df, [r["variable"] for r in rows]).groupBy("variable", case.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(F.when(present("value"), v)).alias("sketch"))
    bins = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))
    agg = per_bin.groupBy("variable").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
                                          F.max("high").alias("high"), bins.alias("_b"), F.kll_merge_agg_double("sketch").alias("sketch"))
    local = df.sparkSession.createDataFrame([(r["variable"], r["edges"], r["median"]) for r in rows], EDGES)
    n_bins = F.size("edges") - 1
    counts = F.when(n_bins >= 2, F.transform(F.sequence(F.lit(0), n_bins - 1), lambda i: F.coalesce(F.try_element_at("_b", i), F.lit(0).cast("long"))))
    zero = F.lit(0).cast("long")
    return local.join(agg, "variable", "left").select(
        "variable", F.coalesce("rows", zero).alias("rows"), F.coalesce("n", zero).alias("n"), "total", "low", "high", "median",
        F.lit(True).alias("exact"), "edges", F.when(F.col("_b").isNull() & (n_bins >= 2), F.array_repeat(zero, n_bins)).otherwise(counts).alias("counts"), "sketch")


def fit_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 10) -> Profile:
    """Profile of a population: exact quantile edges by refinement, then one counting pass."""
    if not numeric:
        return Profile(df.sparkSession.createDataFrame([], NUMERIC), _level_counts(df, categorical))
    qs = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(to_long(df, numeric), "value", sorted({*qs, 0.5}), by=["variable"])
    e = q.groupBy("variable").agg(F.array_sort(F.collect_set(F.when(F.col("q").isin(*qs), F.col("value")))).alias("edges"),
                                  F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"))
    found = {r["variable"]: r for r in e.collect()}      # bins + 2 numbers per declared variable
    local = [(c, found[c]["edges"] if c in found else None, found[c]["median"] if c in found else None) for c in numeric]
    return Profile(_counted(df, df.sparkSession.createDataFrame(local, EDGES)), _level_counts(df, categorical))


def count_on(profile: Profile, df: DataFrame) -> Profile:
    """Another population (or more rows of the same) counted on the edges of a stored profile: one pass. Its
    ``median`` is read from the sketch (rank error about 1.3 %), so ``exact`` is false."""
    cats = [r[0] for r in profile.levels.select("variable").distinct().collect()]      # declared variables
    num = _counted(df, profile.numeric.select("variable", "edges", "median"))
    return Profile(_sketch_median(num), _level_counts(df, cats))


def _sketch_median(num: DataFrame) -> DataFrame:
    has = F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0)) > 0
    return num.withColumn("median", F.when(has, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))).withColumn("exact", F.lit(False))


def merge_profiles(a: Profile, b: Profile) -> Profile:
    """Profile of both populations together, without their rows; ``b`` must have been counted on the edges of ``a``
    (``count_on``), other edges are an error. Sums, counts and sketches add up; the median comes from the sketch."""
    x, y = a.numeric.alias("x"), b.numeric.alias("y")
    j = x.join(y, F.col("x.variable") == F.col("y.variable"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}"))
    both = lambda c: F.when(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull(), F.col(f"x.{c}") + F.col(f"y.{c}")).otherwise(pick(c))
    same = F.col("x.edges").eqNullSafe(F.col("y.edges")) | F.col("x.variable").isNull() | F.col("y.variable").isNull()
    edges = F.when(same, pick("edges")).otherwise(F.raise_error(F.lit("profiles with different edges")).cast("array<double>"))
    counts = F.when(F.col("x.counts").isNotNull() & F.col("y.counts").isNotNull(), F.zip_with("x.counts", "y.counts", lambda p, q: p + q)).otherwise(pick("counts"))
    sketch = F.when(F.col("x.sketch").isNotNull() & F.col("y.sketch").isNotNull(), F.kll_sketch_merge_double("x.sketch", "y.sketch")).otherwise(pick("sketch"))
    num = j.select(pick("variable").alias("variable"), both("rows").alias("rows"), both("n").alias("n"), both("total").alias("total"),
                   F.least("x.low", "y.low").alias("low"), F.greatest("x.high", "y.high").alias("high"), F.lit(None).cast("double").alias("median"),
                   F.lit(False).alias("exact"), edges.alias("edges"), counts.alias("counts"), sketch.alias("sketch"))
    levels = a.levels.unionByName(b.levels).groupBy("variable", "level").agg(F.sum("n").alias("n"))
    return Profile(_sketch_median(num), levels)


def save_profile(profile: Profile, path: str) -> str:
    sinks.sink_table(profile.numeric, f"{path.rstrip('/')}/numeric")
    sinks.sink_table(profile.levels, f"{path.rstrip('/')}/levels")
    return path


def load_profile(spark: SparkSession, path: str) -> Profile:
    return Profile(spark.read.parquet(f"{path.rstrip('/')}/numeric"), spark.read.parquet(f"{path.rstrip('/')}/levels"))


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.transform(counts, lambda x: F.when(F.coalesce(F.try_divide(x, total), F.lit(0.0)) == 0, F.lit(PSI_FLOOR)).otherwise(F.try_divide(x, total)))


def psi_of_counts(a: str, b: str) -> Column:
    """PSI of two count arrays over the same bins (empty bins floored); NULL without bins."""
    return F.aggregate(F.zip_with(_shares(a), _shares(b), lambda p, q: (p - q) * F.log(p / q)), F.lit(0.0), lambda acc, x: acc + x)


def drift_from_profile(profile: Profile, other: DataFrame) -> DataFrame:
    """D1 against a stored profile: the columns of ``drift_table``, reading only the rows of ``other`` (one counting
    pass, and the refinement of its exact medians)."""
    base = profile.numeric
    now = _counted(other, base.select("variable", "edges", "median"))
    names = [r[0] for r in base.select("variable").collect()]       # declared variables
    if not names:
        raise ValueError("the profile has no numeric variable")
    med = exact_quantiles(to_long(other, names), "value", [0.5], by=["variable"]).select("variable", F.col("value").alias("median_pred"))
    h = base.select("variable", F.try_divide("total", "n").alias("mean_hist"), F.col("median").alias("median_hist"), F.col("low").alias("min_hist"),
                    F.col("high").alias("max_hist"), F.col("counts").alias("_a"))
    p = now.select("variable", F.try_divide("total", "n").alias("mean_pred"), F.col("low").alias("min_pred"), F.col("high").alias("max_pred"), F.col("counts").alias("_b"))
    return h.join(p, "variable").join(med, "variable", "left").withColumn("psi", psi_of_counts("_a", "_b")).drop("_a", "_b")


def coverage_of_levels(base: DataFrame, other: DataFrame) -> DataFrame:
    """D12 from two level tables (variable, level, n): rows meet after they were counted, one row a level. A missing
    value of ``other`` is not covered."""
    b = base.where(F.col("level").isNotNull()).select("variable", "level", F.lit(1).alias("_a"))
    o = other.select("variable", "level", "n", F.lit(1).alias("_b"))
    a, v = F.col("_a").isNotNull(), F.col("level").isNotNull()
    return b.join(o, ["variable", "level"], "full_outer").groupBy("variable").agg(
        F.count_if(a).alias("levels_base"), F.count_if(v & F.col("_b").isNotNull()).alias("levels_other"), F.count_if(v & ~a).alias("new_levels"),
        F.try_divide(F.coalesce(F.sum(F.when(a, F.col("n"))), F.lit(0)).cast("double"), F.sum("n")).alias("row_coverage"))


def coverage_from_profile(profile: Profile, other: DataFrame) -> DataFrame:
    """D12 against a stored profile: only the rows of ``other`` are read."""
    cats = [r[0] for r in profile.levels.select("variable").distinct().collect()]      # declared variables
    return coverage_of_levels(profile.levels, _level_counts(other, cats))


# ---------------------------------------------------------------- A4, P4
_NUMBERS = (T.NumericType,)


def column_profile(df: DataFrame, cols: Sequence[str], lg_sketch: int | None = None) -> DataFrame:
    """A4: per column rows, null share, distinct non-null values, smallest value (number or text).

    Exact by default: each value of each column is one row of a map-side aggregate, so one exchange carries the
    distinct values (not one copy of every row a column). With ``lg_sketch`` (4..21) the distinct count is the
    estimate of a mergeable sketch of 2^lg_sketch registers (relative error about 1.04 / sqrt(2^lg_sketch)) and
    the exchange carries one sketch per column and task."""
    def cell(c: str) -> Column:
        number = isinstance(df.schema[c].dataType, _NUMBERS)
        text = (F.col(c) + F.lit(0.0)) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)     # -0.0 is 0.0
        return F.struct(F.lit(c).alias("variable"), text.cast("string").alias("text"),
                        (F.col(c).cast("double") if number else F.lit(None).cast("double")).alias("num"), F.lit(number).alias("number"))

    lng = df.select(F.explode(F.array(*[cell(c) for c in cols])).alias("_s")).select("_s.*")
    if lg_sketch is None:
        v = lng.groupBy("variable", "number", "text").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("num"))
        distinct, n = F.count("text"), F.sum("n")
        nulls = F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0))
    else:
        v = lng
        distinct, n = F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("text", lg_sketch)), F.lit(0)), F.count(F.lit(1))
        nulls = F.count_if(F.col("text").isNull())
    g = v.groupBy("variable", "number").agg(n.alias("rows"), (nulls / n).alias("null_share"), distinct.cast("long").alias("n_distinct"),
                                           F.min("num").alias("example_num"), F.min("text").alias("_t"))
    return g.select("variable", "rows", "null_share", "n_distinct", "example_num", F.when(~F.col("number"), F.col("_t")).alias("example_text"))


def level_report(df: DataFrame, col: str, cleaned: Column, max_levels: int | None = None) -> DataFrame:
    """(n_raw, n_clean, levels, more) of a category before and after cleaning. ``levels`` lists all clean levels in
    order; a caller who names ``max_levels`` gets the first ones, and ``more`` says whether there are others."""
    c = df.groupBy(F.col(col).alias("_r"), cleaned.alias("_c")).agg(F.lit(1).alias("_1"))
    first = c.where(F.col("_c").isNotNull()).select("_c").distinct()
    if max_levels is not None:
        first = first.orderBy("_c").limit(max_levels)
    first = first.agg(F.array_join(F.array_sort(F.collect_list("_c")), ",").alias("levels"))
    n = c.agg(F.countDistinct("_r").alias("n_raw"), F.countDistinct("_c").alias("n_clean"))
    return n.crossJoin(F.broadcast(first)).select("n_raw", "n_clean", "levels", (F.lit(False) if max_levels is None else F.col("n_clean") > max_levels).alias("more"))
