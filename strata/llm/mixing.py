"""Mixing sources to target weights (operator 4) by Efraimidis-Spirakis sampling.

Sources share a token budget by weight; no source gets more than ``max_epochs`` times its size,
and what is over goes to the other sources by weight until none is above. A source's target is
met by complete epochs (every document once per epoch) and a fractional selection: documents in
ascending order of the exponential key -ln(u) / w (u: keyed hash of the document id, w: quality
weight of its text) are taken while more than half of the next one still fits.

No source is gathered in one task. A source's key axis is cut into buckets of about
``bucket_rows`` documents (equal steps of ln(key): whatever the weights, the density of ln(key)
is at most 0.37 per unit), bucket totals give the one bucket in which the budget ends, and only
its rows are sorted. The result is a plan of one row per source with a cut point on the order;
rows compare themselves with it in place.

DataFrame functions only. Cases: null text has size 0; documents of size 0 take nothing from the
budget. The null source is a source like others, ordered last. Equal documents (same id and text)
share one place in the order and are taken together. A null id has the hash of the empty string.
An empty table gives an empty plan and an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import every, let, small, words

SEED = "mix-1"


def size_and_weight(text: Column) -> Column:
    """A struct of a text's size in words and its quality weight in [0.1, 1], the share of its word
    characters that are not symbols or digits."""
    t = F.coalesce(text, F.lit(""))
    noise = F.char_length(t) - F.char_length(F.regexp_replace(t, "[0-9#*$%&|<>]+", ""))
    return let(words(t), lambda ws: let(F.char_length(F.array_join(ws, "")), lambda chars: F.struct(
        F.size(ws).cast("long").alias("size"),
        F.greatest(F.lit(0.1), F.when(chars > 0, 1.0 - noise / chars).otherwise(F.lit(1.0))).alias("weight"))))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / w with u in (0, 1) from 52 bits of a keyed md5: equal on every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2 ** 52))) / weight


def source_rank(sources: DataFrame, col: str) -> DataFrame:
    """``sources`` with ``rank`` (from 0) by code point, nulls last, without a single-task window:
    a global sort, then the row number in a partition plus the partition's start."""
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = materialize(sources.orderBy(F.col(col).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    # one count per sort partition reaches the driver
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(at)]
        at += n
    base = F.element_at(F.create_map(*starts), part.cast("int")) if starts else F.lit(0)
    return ordered.withColumn("rank", (base + row).cast("long")).drop("_at")


def share_out(sources: DataFrame, weight: Column, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """``sources`` (source_size) with ``target``. Each round gives what is left by weight to the
    open sources and closes those above their cap; a round is one aggregate over the source table,
    and only its totals reach the driver."""
    s = materialize(sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * max_epochs))
    level = 0.0
    while True:
        # a source is closed once its weighted level reaches its cap
        closed = F.col("weight") * F.lit(level) > F.col("cap")
        t = s.agg((F.sum("source_size")).alias("total"), F.sum(F.when(closed, F.col("cap"))).alias("closed"),
                  F.sum(F.when(~closed, F.col("weight"))).alias("w")).first()
        left = (t["total"] or 0) * share - (t["closed"] or 0)
        new = left / t["w"] if t["w"] else level
        if not t["w"] or new <= level:
            break
        level = new
    open_target = F.col("weight") * F.lit(level)
    return s.withColumn("target", F.when(open_target > F.col("cap"), F.col("cap").cast("double")).otherwise(open_target)) \
        .drop("cap", "weight")


def _key_bucket(key: Column, steps: Column) -> Column:
    """``steps``: buckets per unit of ln(key), a value of the source's plan row."""
    return F.floor(F.log(key) * steps).cast("long")


def plan_mix(rows: DataFrame, max_epochs: int = 3, share: float = 1.0, cycle: int = 3, bucket_rows: int = 50_000) -> DataFrame:
    """One row per source (source, source_size, target, epochs, cut): ``rows`` has (source, size,
    key, tie). A document's copies are epochs, plus one if its (key, tie) is at most ``cut``."""
    totals = source_rank(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "source")
    target = share_out(totals, F.col("rank") % cycle + 1, max_epochs, share)
    plan = target.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("steps", F.greatest(F.lit(1.0), 0.37 * F.col("docs") / bucket_rows))
    plan = small(plan.select("source", "source_size", "steps", "target", "epochs", "rest"))
    p = plan.select(F.col("source").alias("_source"), "steps", "rest")
    placed = rows.join(p, rows["source"].eqNullSafe(F.col("_source"))).drop("_source") \
        .withColumn("bucket", _key_bucket(F.col("key"), F.col("steps")))
    buckets = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = small(buckets.withColumn("before", before)
                 .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
                 .select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before"))
    # only the rows of the bucket in which the budget ends are sorted
    tail = placed.join(ends, placed["source"].eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))) \
        .groupBy("source", "key", "tie").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, 0))
    taken = tail.withColumn("start", F.col("before") + upto - F.col("size")).filter(F.col("start") + F.col("size") / 2 < F.col("rest"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("key", "tie")).alias("cut"))
    # without a row taken in the last bucket the cut is that bucket's lower edge: everything before it
    edges = ends.select(F.col("_source").alias("e_source"), F.col("_bucket").alias("cut_bucket"))
    cuts = cuts.select(F.col("source").alias("c_source"), "cut")
    return small(plan.join(edges, plan["source"].eqNullSafe(F.col("e_source")), "left")
                 .join(cuts, plan["source"].eqNullSafe(F.col("c_source")), "left")
                 .select("source", "source_size", "steps", "target", "epochs", "rest", "cut_bucket", "cut"))


def copies(plan_row: dict[str, Column], key: Column, tie: Column) -> Column:
    """How often a document is taken, from its source's plan row."""
    bucket = _key_bucket(key, plan_row["steps"])
    at_end = F.coalesce(F.struct(key.alias("key"), tie.alias("tie")) <= plan_row["cut"], F.lit(False))
    extra = F.when(plan_row["cut_bucket"].isNull(), F.lit(0)) \
        .when(bucket < plan_row["cut_bucket"], F.lit(1)) \
        .when((bucket == plan_row["cut_bucket"]) & at_end, F.lit(1)).otherwise(F.lit(0))
    return plan_row["epochs"] + extra


def _shape(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, *keep: Column) -> DataFrame:
    """``keep`` columns with source, size, key and tie."""
    kept = F.struct(*keep, F.col(source).alias("source"), F.col(doc_id).alias("id"))
    s = docs.select(kept.alias("k"), size_and_weight(F.col(text)).alias("s"))
    return s.select("k.*", "s.*").select(
        *[c for c in s.select("k.*").columns if c != "id"], "size", exponential_key(F.col("id"), F.col("weight"), seed).alias("key"),
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("tie"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document row; texts are read
    once, sizes and keys are staged."""
    rows = materialize(_shape(docs, doc_id, text, source, seed, F.col(doc_id).alias("doc_id")))
    return _with_plan(rows, plan_mix(rows.select("source", "size", "key", "tie"), **plan)) \
        .withColumn("taken", F.col("size") * F.col("copies")) \
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.select(F.col("source").alias("_source"), *[F.col(c) for c in ("source_size", "steps", "target", "epochs", "cut_bucket", "cut")])
    at = {c: F.col(c) for c in ("steps", "epochs", "cut_bucket", "cut")}
    return rows.join(p, rows["source"].eqNullSafe(F.col("_source")), "left") \
        .withColumn("copies", copies(at, F.col("key"), F.col("tie")).cast("int"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED,
                    **plan) -> DataFrame:
    """The mix itself: the documents in their own columns, each row repeated as often as it is taken.
    The second pass recomputes size and key in place, so no text is shuffled."""
    shape = ("source", "size", "key", "tie")
    rows = materialize(_shape(docs, doc_id, text, source, seed))
    p = plan_mix(rows.select(*shape), **plan)
    whole = _shape(docs, doc_id, text, source, seed, F.struct(*every(docs)).alias("_row"))
    return _with_plan(whole, p).filter(F.col("copies") > 0) \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
