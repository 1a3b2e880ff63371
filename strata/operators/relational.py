"""Joins, aggregations, set operations, sorts and limits (J*, A*, U*, L*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import with_totals
from .fingerprint import differing_rows
from .order import exact_quantiles, global_rank


# ---------------------------------------------------------------- joins
def left_join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str],
                      not_null: Sequence[str] = ()) -> DataFrame:
    """Left equi-join that fails loudly when the right keys are not unique or a
    required column comes back missing (row count must not change).

    The key guard is a distributed aggregate that runs once, as an action, before the join is
    returned; only "some / none" reaches the driver. Missing values raise in the task that finds them."""
    dup = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    if dup.limit(1).count() > 0:
        raise ValueError(f"left_join_checked: right side has duplicate keys on {list(keys)}")
    res = left.join(right, list(keys), "left")
    for c in not_null:
        res = res.withColumn(c, F.when(F.col(c).isNull(),
                                       F.raise_error(F.lit(f"left_join_checked: missing {c} after join")))
                             .otherwise(F.col(c)))
    return res


def outer_align(a: DataFrame, b: DataFrame, key: str, a_val: str, b_val: str, fill: float | None = 0.0) -> DataFrame:
    """Align two frequency tables on their level; missing → ``fill`` (or NULL)."""
    j = a.select(key, a_val).join(b.select(key, b_val), key, "full_outer")
    return j.fillna(fill, [a_val, b_val]) if fill is not None else j


def semi_cover(pop: DataFrame, other: DataFrame, col: str) -> DataFrame:
    """Share of ``pop`` rows whose value exists in ``other`` (one row)."""
    vals = other.select(F.col(col).alias("_v")).distinct().withColumn("_hit", F.lit(1))
    levels = pop.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))    # a hot value is one row before the join
    hit = F.sum(F.when(F.col("_hit") == 1, F.col("_n")).otherwise(0)).cast("double")
    return levels.join(vals, F.col(col) == F.col("_v"), "left").agg(F.try_divide(hit, F.sum("_n")).alias("cover"))


def scenario_cross(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every row × a short scenario list (literal-sized, so the broadcast is bounded)."""
    return df.crossJoin(F.broadcast(scenarios))


# ---------------------------------------------------------------- aggregates
def value_counts(df: DataFrame, col: str, normalize: bool = True, dropna: bool = True,
                 top: int | None = None) -> DataFrame:
    """A5: counts and shares by level; the share denominator excludes nulls unless
    ``dropna=False`` (then null is its own level)."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    vc = d.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        tot = d.agg(F.count(F.lit(1)).alias("_tot"))
        vc = with_totals(vc, tot).withColumn("share", F.col("n") / F.col("_tot")).drop("_tot")
    if top:
        vc = vc.orderBy(F.col("n").desc(), F.col(col).asc_nulls_last()).limit(top)
    return vc


def share_of_total(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Group value as % of the grand total (1-row broadcast)."""
    tot = df.agg(F.sum(value).alias("_tot"))
    return with_totals(df, tot).withColumn(out, 100.0 * F.try_divide(F.col(value), F.col("_tot"))).drop("_tot")


def index_vs_global(grouped: DataFrame, global_row: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: each group statistic as an index of its global value (global = 100)."""
    g = global_row.select(*[F.col(c).alias(f"_g_{c}") for c in cols])
    res = with_totals(grouped, g)
    for c in cols:
        res = res.withColumn(f"idx_{c}", 100.0 * F.try_divide(F.col(c), F.col(f"_g_{c}")))
    return res.drop(*[f"_g_{c}" for c in cols])


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence, value: str | None = None,
             agg: str = "count", normalize_columns: bool = False) -> DataFrame:
    """Pivot of two columns with a declared level list (no extra pass to discover
    levels). count/sum → 0 for empty cells, mean → NULL; column-normalised on request."""
    g = df.groupBy(row).pivot(col, list(levels))
    if agg == "count":
        res = g.count().fillna(0, [str(l) for l in levels])
    elif agg == "sum":
        res = g.agg(F.sum(value)).fillna(0, [str(l) for l in levels])
    elif agg == "mean":
        res = g.agg(F.avg(value))
    else:
        raise ValueError(agg)
    if normalize_columns:
        tot = res.agg(*[F.sum(F.col(str(l))).alias(f"_t_{l}") for l in levels])
        res = with_totals(res, tot)
        for l in levels:
            res = res.withColumn(str(l), F.try_divide(F.col(str(l)), F.col(f"_t_{l}")))
        res = res.drop(*[f"_t_{l}" for l in levels])
    return res


def histogram(df: DataFrame, col: str, bins: int = 20, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Equal-width histogram over [lo, hi], last bin closed; empty bins kept."""
    spark = df.sparkSession
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(col) - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    counts = (df.where((F.col(col) >= lo) & (F.col(col) <= hi)).select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left").fillna(0, ["n"])
            .withColumn("lo", F.lit(lo) + F.col("bin") * F.lit(width))
            .withColumn("hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: count, mean, std (ddof=1), min, quartiles, max per numeric column — one unpivot,
    one grouped aggregate, one distributed exact-quantile pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("s")).select("s.variable", "s.v")
    base = (long.where(F.col("v").isNotNull()).groupBy("variable")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                 F.min("v").alias("min"), F.max("v").alias("max")))
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=["variable"])
    qp = q.groupBy("variable").agg(*[F.max(F.when(F.col("q") == qq, F.col("value"))).alias(name)
                                    for qq, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(qp, "variable")


def grouped_median(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Exact median per group via the distributed order-statistic path."""
    return exact_quantiles(df, col, [0.5], by=by).select(*by, F.col("value").alias(out))


def top_groups(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Groups ranked by a sum, top n (ties by key)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .orderBy(F.col("total").desc(), F.col(key).asc()).limit(n))


# ---------------------------------------------------------------- sets and duplicates
def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Size of the key intersection (distinct)."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("overlap"))


def new_levels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Levels present in ``b`` and absent from ``a``."""
    return b.select(col).where(F.col(col).isNotNull()).distinct().subtract(a.select(col).distinct())


def schema_diff(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """Columns present in only one of two tables (compared on trimmed names), from
    the schemas alone — no data pass."""
    ca = {f.name.strip(): f.dataType.simpleString() for f in a.schema.fields}
    cb = {f.name.strip(): f.dataType.simpleString() for f in b.schema.fields}
    rows = [(c, name_a, t) for c, t in ca.items() if c not in cb] + [(c, name_b, t) for c, t in cb.items() if c not in ca]
    return a.sparkSession.createDataFrame(sorted(rows), "column string, only_in string, type string")


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows equal to an earlier row on ``cols`` (nulls compare equal, as in pandas)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicates")))


def dedupe_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (include a unique column last so the
    pick is deterministic). Window form: use when the order mixes directions on text."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_best_agg(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """U6 as an aggregate: ``min_by(row, ordering struct)`` per key. Partial aggregation
    runs map-side, so a key holding a third of all rows never lands whole in one task.
    ``order`` is [(column, ascending)]; descending columns must be numeric (negated)."""
    parts = []
    for c, asc in order:
        if not asc and df.schema[c].dataType.typeName() not in ("integer", "long", "double", "float", "short", "decimal"):
            raise ValueError(f"descending order on non-numeric column {c}: use dedupe_best")
        parts.append(F.col(c) if asc else -F.col(c))
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*parts)).alias("_best"))
    return best.select(*keys, "_best.*")


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset equality (order-free) as one row: rows only in a, only in b, equal flag. An ordinal
    column in both tables makes it an ordered comparison.

    Checksums of hash buckets (128 bits a row) are compared first; only rows of buckets that differ are
    matched one by one. Column types must agree."""
    n = differing_rows(a, b).agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("only_a"),
                                 F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("only_b"))
    return n.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def sequence_check(df: DataFrame, key: str) -> DataFrame:
    """U8: keys are exactly 1..n."""
    return (df.agg(F.min(key).alias("mn"), F.max(key).alias("mx"), F.countDistinct(key).alias("nd"),
                   F.count(F.lit(1)).alias("n"))
            .select(((F.col("mn") == 1) & (F.col("mx") == F.col("n")) & (F.col("nd") == F.col("n"))).alias("is_sequence"),
                    "n"))


# ---------------------------------------------------------------- sorts and limits
def topk(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """L3: top-K by score (ties by key). ``orderBy().limit`` plans as TakeOrderedAndProject:
    each task keeps K rows, so the driver-side merge is bounded by K × tasks."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def topk_stats(df: DataFrame, score: str, key: str, ks: Sequence[int], aggs: Sequence[Column]) -> DataFrame:
    """L4: aggregates over the top K rows for several K in one rank pass (G0) plus a
    bounded scenario cross join of K values."""
    ranked = global_rank(df, score, key, descending=True, out="_rk")
    kdf = df.sparkSession.createDataFrame([(int(k),) for k in ks], "K long")
    # only the top max(K) rows are crossed with the (literal-sized) K list
    return (ranked.where(F.col("_rk") <= max(ks)).crossJoin(F.broadcast(kdf)).where(F.col("_rk") <= F.col("K"))
            .groupBy("K").agg(*aggs))


#: Hex digits by which one counting pass refines the cut of a sample (4,096 counts to the driver).
CUT_DIGITS = 3
#: Rows of the cut's own prefix that are ordered at most, unless their hashes are equal to the last digit.
CUT_ROWS = 100_000


def sample_seeded(df: DataFrame, key: str, n: int, seed: int = 42, cut_rows: int = CUT_ROWS) -> DataFrame:
    """L5 without replacement: the n rows with the smallest md5(key‖seed), ties by an md5 of the whole row —
    reproducible under any partitioning. All rows if there are fewer.

    The cut is found by counting hash prefixes: one aggregate of at most 4,096 counts fixes three more hex
    digits, until at most ``cut_rows`` rows share the cut's prefix. Rows below it are taken by a filter,
    where they are; only rows of the cut's prefix are ordered. n may be any share of the table."""
    if n <= 0:
        return df.limit(0)
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    hashed = df.withColumn("_h", F.concat(h, whole))
    prefix, need = "", n
    while len(prefix) < 64:
        p = F.substring("_h", len(prefix) + 1, CUT_DIGITS)
        counts = hashed.where(F.col("_h").startswith(prefix)).groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("c")) \
            .orderBy("p").collect()      # at most 16^CUT_DIGITS rows
        cut = None
        for row in counts:
            if row["c"] >= need:
                cut = row
                break
            need -= row["c"]
        if cut is None:
            return df        # fewer rows than n (only the first pass can end so)
        prefix += cut["p"]
        if cut["c"] <= cut_rows:
            break
    whole_below = hashed.where(F.substring("_h", 1, len(prefix)) < prefix)
    at_cut = hashed.where(F.col("_h").startswith(prefix)).orderBy("_h").limit(need)
    return whole_below.unionByName(at_cut).drop("_h")


def sample_bootstrap(df: DataFrame, seed: int = 42) -> DataFrame:
    """L5 with replacement: Poisson(1) row weights (size approximately n)."""
    return df.sample(withReplacement=True, fraction=1.0, seed=seed)
