"""URL filters (operator 10): fixed host/path rules first, association rules mined from labelled
pages for the rest. DataFrame and MLlib (JVM) code only.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and has no
tokens, so it is allowed. Repeated pages are judged row by row. Repeated or contradicting labels
of one page count as one label, bad if any row says so. Null labels take no part. Without
labelled pages nothing is mined and every page that no fixed rule fits is allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS, small

#: Fixed values: (verdict, host, path) rules of the filter list.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; nulls if none fits. The list is a
    parameter of fixed length, so it is one CASE expression, longest rule first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fit = _fits(host, path, h, p)
        rule = F.when(fit, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fit, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Items of a url: its host labels, its path words with digits folded to ``0``, its query
    keys and its scheme, each with a prefix that names the place."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.when(url.contains("://"), F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)))) \
        .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, parts, keys, scheme))


def mine(baskets: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5,
         max_items: int = 3, min_count: int = 8) -> DataFrame:
    """Rules ``antecedent -> bad`` from (tokens, bad) rows: FP-growth over the tokens plus a
    class item, kept if support (relative and as a count), confidence and lift are high enough, the antecedent has at most
    ``max_items`` tokens, and no kept rule with a part of its tokens is as confident."""
    schema = "rule_id long, antecedent array<string>, confidence double, support double, n_bad long"
    spark = baskets.sparkSession
    items = materialize(baskets.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")))
    total = items.agg(F.count("*").alias("n"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    if not total["n"] or not total["bad"]:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(items)
    sets = materialize(model.freqItemsets)
    bad = sets.filter(F.array_contains("items", BAD) & F.size("items").between(2, max_items + 1)) \
        .select(F.array_sort(F.array_remove("items", BAD)).alias("antecedent"), F.col("freq").alias("n_bad"))
    every = sets.filter(~F.array_contains("items", BAD) & (F.size("items") <= max_items)) \
        .select(F.array_sort("items").alias("antecedent"), "freq")
    base = total["bad"] / total["n"]
    rules = bad.join(every, "antecedent").withColumn("confidence", F.col("n_bad") / F.col("freq")) \
        .withColumn("support", F.col("n_bad") / F.lit(float(total["n"]))) \
        .filter((F.col("n_bad") >= min_count) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * base))
    # a longer rule is redundant if a proper part of it is as confident: look up its own parts (at
    # most max_items of them per rule and level), not all pairs of rules
    parts = rules.select("antecedent", "confidence", F.explode("antecedent").alias("out")) \
        .select("antecedent", "confidence", F.array_remove("antecedent", F.col("out")).alias("part")).filter(F.size("part") > 0)
    singles = rules.select("antecedent", "confidence", F.explode("antecedent").alias("one")) \
        .filter(F.size("antecedent") > 1).select("antecedent", "confidence", F.array("one").alias("part"))
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    redundant = parts.union(singles).join(shorter, "part").filter(F.col("part_confidence") >= F.col("confidence")) \
        .select("antecedent").distinct()
    kept = rules.join(redundant, "antecedent", "left_anti")
    return materialize(kept.select(F.xxhash64(F.concat_ws(" ", "antecedent")).alias("rule_id"), "antecedent", "confidence", "support", "n_bad"))


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule_hits) of the token sets that some rule fits, by an inverted index: every rule
    is listed under its last token in code-point order; a set looks its tokens up there and the
    rest of the rule is checked on the spot."""
    index = rules.select(F.element_at("antecedent", -1).alias("tok"), F.col("antecedent").alias("rule_items"))
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    return token_sets.withColumn("tok", F.explode("tokens")).join(index, "tok") \
        .filter(F.size(F.array_except("rule_items", "tokens")) == 0) \
        .groupBy("tokens").agg(F.count("*").alias("rule_hits"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the number of mined rules that
    fit; ``labels`` (page_id, bad boolean) teach the mined rules."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path) \
        .withColumn("tokens", F.array_sort(tokens(F.col("url"), F.col("host"), F.col("path")))) \
        .withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    teach = labels.groupBy("page_id").agg(F.max("bad").alias("bad")).filter(F.col("bad").isNotNull())
    mined = mine(parsed.select("page_id", "tokens").join(teach, "page_id"), **mining)
    # pages with equal tokens share one look-up
    hits = small(matched(parsed.select("tokens").distinct(), mined))
    return parsed.join(hits, "tokens", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rule_hits") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("rule_hits", F.lit(0)).cast("long").alias("rule_hits"))
