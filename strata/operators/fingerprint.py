"""Table fingerprints: order-free checksums per hash bucket.

Two tables are compared by at most ``BUCKETS`` small rows each. Rows themselves are matched only where
the checksums of a bucket differ, so equal tables never shuffle a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
_SUMS = ("rows", "a_hi", "a_lo", "b_hi", "b_lo")


def _row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row. A null leaves a hash as it was, so each column's null flag is hashed too:
    (null, 1) and (1, null) differ. NaN equals NaN and -0.0 equals 0.0, as in set operations."""
    cells = [c for name in columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *reversed(cells))


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    a, b = _row_hashes(df.columns)
    return df.withColumn("_a", a).withColumn("_b", b).withColumn("_bucket", F.pmod("_a", F.lit(buckets)).cast("int"))


def bucket_sums(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, a_hi, a_lo, b_hi, b_lo): sums of the 32-bit halves of both hashes, one map-side aggregate.
    A bucket of up to 2^31 rows stays within a long."""
    x = _hashed(df, buckets)
    hi = lambda c: F.shiftrightunsigned(c, 32)
    lo = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return x.groupBy(F.col("_bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(hi("_a")).alias("a_hi"), F.sum(lo("_a")).alias("a_lo"),
        F.sum(hi("_b")).alias("b_hi"), F.sum(lo("_b")).alias("b_lo"))


def fingerprint(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (rows, checksum): row count and SHA-256 over the ordered bucket sums (at most ``buckets`` rows).
    Equal for any order and partitioning of the same rows; column names take no part, types do.
    An empty table has 0 rows and the checksum of the empty text."""
    line = F.concat_ws(",", F.col("bucket"), *_SUMS)
    s = bucket_sums(df, buckets).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                                     F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return s.select("rows", F.sha2("t", 256).alias("checksum"))


def differing_rows(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Multiset difference: the distinct rows whose counts differ, with ``_n`` = copies in ``a`` minus copies
    in ``b``. Columns are matched by position and take the names of ``a``; their types must be equal.

    Bucket sums are compared first; only rows of buckets that differ are grouped. The list of those buckets
    is broadcast: it has at most ``buckets`` integers. Copies of one row are counted before the shuffle."""
    ta, tb = [f.dataType.simpleString() for f in a.schema.fields], [f.dataType.simpleString() for f in b.schema.fields]
    if ta != tb:
        raise ValueError(f"tables with different column types: {ta} and {tb}")
    b = b.toDF(*a.columns)
    sa, sb = bucket_sums(a, buckets), bucket_sums(b, buckets)
    same = F.lit(True)
    for c in _SUMS:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    open_ = sa.alias("x").join(sb.alias("y"), F.col("x.bucket") == F.col("y.bucket"), "full_outer") \
        .where(~same).select(F.coalesce("x.bucket", "y.bucket").alias("_bucket"))
    rows = _hashed(a, buckets).withColumn("_side", F.lit(1)).unionByName(_hashed(b, buckets).withColumn("_side", F.lit(-1)))
    left = rows.join(F.broadcast(open_), "_bucket", "left_semi")
    keys = [F.col(f"`{c}`") for c in a.columns]
    return left.groupBy(*keys).agg(F.sum("_side").alias("_n")).where("_n <> 0")
