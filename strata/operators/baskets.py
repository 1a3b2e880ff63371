"""Market-basket operators.

Frequent itemsets are mined level by level on bitmaps of baskets, up to a length bound.
Rules are generated by the build itself because every antecedent/consequent
split is needed, not only single-item consequents: each itemset of n ≤ max_len items
has 2^n − 2 splits, enumerated with array functions (at most 30 per itemset), and the
supports are looked up by equi-joins on canonical (sorted) item arrays."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import with_totals
from ..functions.scalar import set_to_text
from ..session import materialize, ship_package
from .graph import connected_components

#: Baskets of a bitmap range: 512 bytes an item and range.
RANGE = 4096


def basket_long(wide: DataFrame, id_col: str, item_cols: Sequence[str]) -> DataFrame:
    """B1: wide 0/1 matrix → long (basket_id, item); empty baskets disappear."""
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("int").alias("_v")) for c in item_cols]))
    return (wide.select(F.col(id_col).alias("basket_id"), s.alias("_s"))
            .where(F.col("_s._v") == 1).select("basket_id", F.col("_s.item").alias("item")))


def basket_arrays(long: DataFrame) -> DataFrame:
    """One sorted item array per basket (bounded by the basket size)."""
    return long.groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def item_support(long: DataFrame, low: float = 0.01) -> DataFrame:
    """B2: share of baskets that hold each item, and a flag for items below ``low``."""
    nb = long.agg(F.countDistinct("basket_id").alias("_nb"))
    c = long.groupBy("item").agg(F.countDistinct("basket_id").alias("n"))
    return (with_totals(c, nb).withColumn("support", F.col("n") / F.col("_nb"))
            .withColumn("below_min", F.col("support") < low).drop("_nb"))


def _tid_lists(batches):
    """Bitmaps of the baskets that hold each item, per range of at most ``RANGE`` baskets; item null: the baskets."""
    schema = pa.schema([("range", pa.int64()), ("item", pa.string()), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, batch.num_rows, RANGE):
            lists = batch.column(0).slice(lo, RANGE)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            words = -(-len(lists) // 64)
            bits = np.zeros((len(coded.dictionary), words), np.uint64)
            code = coded.indices.to_numpy()
            np.bitwise_or.at(bits, (code, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
            k = len(bits)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * words), pa.array(bits.ravel().view(np.int64)))
            counts = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, at)), coded.dictionary.cast(pa.string()), pa.array(counts), flat], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([None], pa.string()), pa.array([len(lists)]), pa.array([None], flat.type)], schema=schema)
            at += 1


def _candidates(found: DataFrame, size: int) -> DataFrame:
    """(items, left, last): sets of ``size`` + 1 items all of whose subsets of ``size`` items are in ``found``. Two sets
    with the same first items give one; then each candidate looks up its own subsets."""
    a = found.select(F.slice("items", 1, size - 1).alias("prefix"), F.col("items").alias("left"))
    b = found.select(F.slice("items", 1, size - 1).alias("prefix"), F.element_at("items", -1).alias("last"))
    made = a.join(b, "prefix").where(F.element_at("left", -1) < F.col("last")) \
        .select(F.concat("left", F.array("last")).alias("items"), "left", "last")
    if size == 1:      # both parts are frequent by themselves
        return made
    part = F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part")
    whole = made.select("items", part).join(found.select(F.col("items").alias("part")), "part") \
        .groupBy("items").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == size + 1).select("items")
    return made.join(whole, "items", "left_semi")


def frequent_itemsets(long: DataFrame, min_support: float = 0.01, max_len: int = 5) -> DataFrame:
    """Itemsets with support ≥ min_support and at most ``max_len`` items:
    (items sorted array, size, n baskets, support), mined level by level.

    Baskets become bitmaps per (basket range, item). A candidate of k + 1 items is made only if all its parts of
    k items are frequent; its bitmap in a range is the AND of a frequent part's and its last item's, so no set above
    ``max_len`` and none with an infrequent part is ever counted. The result is a stored table: rules,
    filters and edges built on it do not mine again. Null items are left out; baskets of nulls only count as baskets."""
    ship_package(long.sparkSession)
    tids = materialize(basket_arrays(long).select("items").mapInArrow(_tid_lists, "range long, item string, n long, bits array<long>"))
    n_baskets = tids.where("item IS NULL").agg(F.sum("n")).first()[0] or 0
    low = F.lit(min_support) * F.lit(n_baskets)
    singles = tids.where("item IS NOT NULL")
    found = materialize(singles.groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= low).select(F.array("item").alias("items"), "n"))
    singles = materialize(singles.join(found.select(F.col("items")[0].alias("item")), "item", "left_semi").select("range", "item", "bits"))
    levels, now = [found], singles.select("range", F.array("item").alias("left"), "bits")
    for size in range(1, max_len):
        wanted = _candidates(found, size)
        pairs = now.join(wanted, "left").join(singles.select("range", F.col("item").alias("last"), F.col("bits").alias("_b")), ["range", "last"]) \
            .select("range", "items", F.zip_with("bits", "_b", lambda x, y: x.bitwiseAND(y)).alias("bits")) \
            .withColumn("n", F.aggregate("bits", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))).where("n > 0")
        pairs = materialize(pairs)
        found = materialize(pairs.groupBy("items").agg(F.sum("n").alias("n")).where(F.col("n") >= low))
        if found.isEmpty():
            break
        levels.append(found)
        now = pairs.join(found.select("items"), "items", "left_semi").select("range", F.col("items").alias("left"), "bits")
    return functools.reduce(DataFrame.unionByName, levels) \
        .select("items", "n", (F.col("n") / F.lit(n_baskets)).alias("support"), F.size("items").alias("size"))


def _splits(items: Column) -> Column:
    """All (antecedent, consequent) pairs of an item array, as an array of structs."""
    n = F.size(items)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 2)
    idx = F.sequence(F.lit(0), n - 1)

    def split(m):
        ante = F.transform(F.filter(idx, lambda i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0), lambda i: F.element_at(items, i + 1))
        cons = F.transform(F.filter(idx, lambda i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) == 0), lambda i: F.element_at(items, i + 1))
        return F.struct(ante.alias("antecedent"), cons.alias("consequent"))

    return F.transform(masks, split)


def association_rules(itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """B4 + B5: every split of every frequent itemset of size ≥ 2, with support,
    confidence, lift, leverage, conviction (NULL when confidence = 1) and n baskets;
    rules with lift ≥ ``min_lift`` (inclusive)."""
    sup = itemsets.select(F.col("items").alias("_k"), F.col("support").alias("_s"))
    multi = itemsets.where(F.col("size") >= 2)
    sp = multi.select("items", "n", F.col("support").alias("support"), F.explode(_splits(F.col("items"))).alias("_r")) \
        .select("items", "n", "support", F.col("_r.antecedent").alias("antecedent"), F.col("_r.consequent").alias("consequent"))
    a = sup.select(F.col("_k").alias("antecedent"), F.col("_s").alias("antecedent_support"))
    c = sup.select(F.col("_k").alias("consequent"), F.col("_s").alias("consequent_support"))
    r = sp.join(a, "antecedent").join(c, "consequent")
    conf = F.col("support") / F.col("antecedent_support")
    r = (r.withColumn("confidence", conf)
         # symmetric form: lift(A→C) and lift(C→A) are the same double, so ties stay ties
         .withColumn("lift", F.col("support") / (F.col("antecedent_support") * F.col("consequent_support")))
         .withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
         .withColumn("conviction", F.when(F.col("confidence") < 1,
                                          (1 - F.col("consequent_support")) / (1 - F.col("confidence")))))
    return r.where(F.col("lift") >= min_lift)


def rule_filter(rules: DataFrame, lift_min: float = 1.20, n_min: int = 100, conf_factor: float = 1.2) -> DataFrame:
    """Lift > lift_min, n ≥ n_min, confidence > conf_factor·consequent support,
    leverage > 0."""
    return rules.where((F.col("lift") > lift_min) & (F.col("n") >= n_min)
                       & (F.col("confidence") > F.col("consequent_support") * conf_factor) & (F.col("leverage") > 0))


def _proper_subsets(items: Column) -> Column:
    """Non-empty proper subsets (2^n − 2 of them); none for n < 2 (``sequence`` would
    count down otherwise)."""
    n = F.size(items)
    masks = F.sequence(F.lit(1), F.greatest(F.pow(F.lit(2), n).cast("int") - 2, F.lit(1)))
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    subs = F.transform(masks, lambda m: F.transform(F.filter(idx, lambda i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0),
                                                    lambda i: F.element_at(items, i + 1)))
    return F.when(n >= 2, subs).otherwise(F.array().cast("array<array<string>>"))


def subset_pairs(itemsets: DataFrame, score: str = "lift") -> DataFrame:
    """(inner, outer) itemset pairs where inner ⊂ outer strictly and outer's score is
    at least inner's. Found as an equi-join of each outer itemset's proper subsets
    (≤ 2^5 − 2 per itemset) with the itemsets — never a pairwise comparison."""
    sub = itemsets.select(F.explode(_proper_subsets(F.col("items"))).alias("inner"), F.col("items").alias("outer"),
                          F.col(score).alias("_outer_score"))
    inner = itemsets.select(F.col("items").alias("inner"), F.col(score).alias("_inner_score"))
    return (inner.join(sub, "inner").where(F.col("_outer_score") >= F.col("_inner_score"))
            .select("inner", "outer", F.col("_inner_score").alias(f"inner_{score}"), F.col("_outer_score").alias(f"outer_{score}")))


def rule_collapse(rules: DataFrame) -> DataFrame:
    """One representative rule per itemset (highest lift, then confidence, then the
    antecedent text), then drop every itemset strictly contained in another retained
    itemset with a lift at least as high.

    Containment is found without pairing itemsets: each retained itemset lists its own
    proper subsets (≤ 2^5 − 2 = 30), and those are equi-joined to the retained itemsets.
    Containment and ≥ are transitive, so a plain anti-join equals the sequential loop."""
    w = Window.partitionBy("items").orderBy(F.col("lift").desc(), F.col("confidence").desc(),
                                            set_to_text("antecedent").asc())
    rep = rules.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    sub = rep.select(F.explode(_proper_subsets(F.col("items"))).alias("items"), F.col("lift").alias("_big_lift"))
    dominated = rep.select("items", "lift").join(sub, "items").where(F.col("_big_lift") >= F.col("lift")).select("items").distinct()
    return rep.join(dominated, "items", "left_anti")


def cooccur_edges(retained: DataFrame) -> DataFrame:
    """Item pairs inside retained itemsets (≤ 10 per itemset of ≤ 5 items), weight =
    max lift over the itemsets that hold the pair."""
    a = retained.select("lift", F.posexplode("items").alias("i", "src"), "items")
    pairs = a.select("lift", "i", "src", F.posexplode("items").alias("j", "dst")).where(F.col("i") < F.col("j"))
    return pairs.groupBy("src", "dst").agg(F.max("lift").alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edge table, whatever its diameter (see
    :mod:`strata.operators.graph`). Returns (node, component, size)."""
    labels = connected_components(edges, "src", "dst")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "component").select("node", "component", "size")
