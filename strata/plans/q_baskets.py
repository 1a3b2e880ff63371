"""Checked queries for market-basket operators (B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import baskets as B
from .registry import query, r

MIN_SUPPORT = 0.01
MAX_LEN = 5
# on random fixture baskets a lift limit of 1.20 returns nothing; thresholds are parameters
FILTER = dict(lift_min=1.0, n_min=100, conf_factor=1.0)


def _items_sql(src: str, max_len: int = MAX_LEN) -> str:
    parts = ["SELECT [item] AS items, count(*) AS n FROM b GROUP BY item"]
    for k in range(2, max_len + 1):
        sel = ", ".join(f"b{i}.item" for i in range(1, k + 1))
        joins = " ".join(f"JOIN b b{i} ON b{i}.basket_id = b1.basket_id AND b{i - 1}.item < b{i}.item" for i in range(2, k + 1))
        parts.append(f"SELECT [{sel}] AS items, count(*) AS n FROM b b1 {joins} GROUP BY 1")
    return f"""b AS MATERIALIZED (SELECT DISTINCT basket_id, item FROM {src}),
nb AS (SELECT count(DISTINCT basket_id) AS nb FROM b),
fi AS MATERIALIZED (SELECT items, n, n / nb AS support, len(items) AS size FROM ({' UNION ALL '.join(parts)}), nb WHERE n >= {MIN_SUPPORT} * nb)"""


RULES_SQL = """
sp AS MATERIALIZED (SELECT i.items, i.n, i.support, a.items AS antecedent, a.support AS antecedent_support,
       c.items AS consequent, c.support AS consequent_support
       FROM fi i JOIN fi a ON len(a.items) < len(i.items) AND list_has_all(i.items, a.items)
       JOIN fi c ON c.items = list_filter(i.items, lambda x: NOT list_contains(a.items, x))
       WHERE i.size >= 2),
rules AS (SELECT *, support / antecedent_support AS confidence, support / (antecedent_support * consequent_support) AS lift,
       support - antecedent_support * consequent_support AS leverage,
       CASE WHEN support / antecedent_support < 1 THEN (1 - consequent_support) / (1 - support / antecedent_support) END AS conviction
       FROM sp WHERE support / (antecedent_support * consequent_support) >= 1.0)"""

COLLAPSE_SQL = f"""
filt AS (SELECT * FROM rules WHERE lift > {FILTER['lift_min']} AND n >= {FILTER['n_min']}
         AND confidence > consequent_support * {FILTER['conf_factor']} AND leverage > 0),
rep AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY items ORDER BY lift DESC, confidence DESC,
        array_to_string(antecedent, ' + ')) AS rn FROM filt) WHERE rn = 1),
kept AS (SELECT * FROM rep s WHERE NOT EXISTS (SELECT 1 FROM rep g WHERE len(g.items) > len(s.items)
         AND list_has_all(g.items, s.items) AND g.lift >= s.lift))"""

RULE_COLS_SQL = """array_to_string(antecedent, ' + ') AS antecedent_txt, array_to_string(consequent, ' + ') AS consequent_txt, n,
  round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) AS leverage,
  round(conviction, 6) AS conviction"""


def rule_cols(df):
    return df.select(S.set_to_text("antecedent").alias("antecedent_txt"), S.set_to_text("consequent").alias("consequent_txt"),
                     "n", *[r(c).alias(c) for c in ["support", "confidence", "lift", "leverage", "conviction"]])


def mined(fx, view: str):
    """The itemsets of a view, mined once per query: all that is built on them reads one stored table."""
    tables = fx.__dict__.setdefault("_mined", {})
    if view not in tables:
        tables[view] = B.frequent_itemsets(getattr(fx, view), MIN_SUPPORT, MAX_LEN)
    return tables[view]


def type_rules(fx):
    return B.association_rules(mined(fx, "baskets_type"), 1.0)


def type_collapsed(fx):
    return B.rule_collapse(B.rule_filter(type_rules(fx), **FILTER))


@query("basket_long", "SELECT basket_id, item FROM baskets_type")
def basket_long(fx):
    items = [r_[0] for r_ in fx.baskets_type.select("item").distinct().orderBy("item").collect()]  # ≤ item count
    wide = (fx.baskets_type.groupBy("basket_id").pivot("item", items).agg(F.lit(1)).fillna(0))
    return B.basket_long(wide, "basket_id", items)


@query("item_support", """
WITH nb AS (SELECT count(DISTINCT basket_id) AS nb FROM baskets_brand)
SELECT item, count(DISTINCT basket_id) AS n, round(count(DISTINCT basket_id) / max(nb), 6) AS support,
  count(DISTINCT basket_id) / max(nb) < 0.01 AS below_min FROM baskets_brand, nb GROUP BY item""")
def item_support(fx):
    return B.item_support(fx.baskets_brand).withColumn("support", r("support"))


@query("frequent_itemsets", f"""WITH {_items_sql('baskets_type')}
SELECT array_to_string(items, ' + ') AS itemset, size, n, round(support, 6) AS support FROM fi""")
def frequent_itemsets(fx):
    fi = mined(fx, "baskets_type")
    return fi.select(S.set_to_text("items").alias("itemset"), "size", "n", r("support").alias("support"))


@query("itemset_sizes", f"""WITH {_items_sql('baskets_type')}
SELECT size, count(*) AS itemsets FROM fi GROUP BY size""")
def itemset_sizes(fx):
    fi = mined(fx, "baskets_type")
    return fi.groupBy("size").agg(F.count(F.lit(1)).alias("itemsets"))


@query("association_rules", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}
SELECT {RULE_COLS_SQL} FROM rules""")
def association_rules(fx):
    return rule_cols(type_rules(fx))


@query("rule_metrics", f"""WITH {_items_sql('baskets_brand')}, {RULES_SQL}
SELECT {RULE_COLS_SQL} FROM rules""")
def rule_metrics(fx):
    fi = mined(fx, "baskets_brand")
    return rule_cols(B.association_rules(fi, 1.0))


@query("rule_filter", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}
SELECT {RULE_COLS_SQL} FROM filt""")
def rule_filter(fx):
    return rule_cols(B.rule_filter(type_rules(fx), **FILTER))


@query("rule_collapse", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}
SELECT array_to_string(items, ' + ') AS itemset, len(items) AS size, {RULE_COLS_SQL} FROM kept""")
def rule_collapse(fx):
    k = type_collapsed(fx)
    return k.select(S.set_to_text("items").alias("itemset"), F.size("items").alias("size"),
                    S.set_to_text("antecedent").alias("antecedent_txt"), S.set_to_text("consequent").alias("consequent_txt"),
                    "n", *[r(c).alias(c) for c in ["support", "confidence", "lift", "leverage", "conviction"]])


@query("trap_rules", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}
SELECT count(*) FILTER (WHERE confidence > 0.2 AND lift < 1.2) AS trap_rules, count(*) AS rules FROM rules""")
def trap_rules(fx):
    return type_rules(fx).agg(F.count_if((F.col("confidence") > 0.2) & (F.col("lift") < 1.2)).alias("trap_rules"),
                              F.count(F.lit(1)).alias("rules"))


@query("same_basket_rules", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL},
top AS (SELECT items FROM kept ORDER BY lift DESC, confidence DESC, array_to_string(items, ' + ') LIMIT 1)
SELECT {RULE_COLS_SQL} FROM rules WHERE items = (SELECT items FROM top)""")
def same_basket_rules(fx):
    top = type_collapsed(fx).orderBy(F.col("lift").desc(), F.col("confidence").desc(), S.set_to_text("items")) \
        .limit(1).select("items")
    return rule_cols(type_rules(fx).join(top, "items", "left_semi"))


@query("combos", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}
SELECT array_to_string(items, ' + ') AS itemset, len(items) AS size, n, round(support, 6) AS support,
  round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM kept
ORDER BY lift DESC, confidence DESC, itemset LIMIT 10""")
def combos(fx):
    k = type_collapsed(fx).withColumn("itemset", S.set_to_text("items"))
    return (k.orderBy(F.col("lift").desc(), F.col("confidence").desc(), F.col("itemset")).limit(10)
            .select("itemset", F.size("items").alias("size"), "n", r("support").alias("support"),
                    r("confidence").alias("confidence"), r("lift").alias("lift")))


EDGES_SQL = """
edges AS (SELECT a.x AS src, b.x AS dst, max(lift) AS weight FROM
  (SELECT items, lift, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM kept) a
  JOIN (SELECT items, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM kept) b ON a.items = b.items AND a.i < b.i
  GROUP BY 1, 2)"""


@query("cooccur_edges", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}, {EDGES_SQL}
SELECT src, dst, round(weight, 6) AS weight FROM edges""")
def cooccur_edges(fx):
    return B.cooccur_edges(type_collapsed(fx)).withColumn("weight", r("weight"))


@query("components", f"""WITH RECURSIVE {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}, {EDGES_SQL},
und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach(node, r) AS (SELECT src, src FROM und UNION SELECT reach.node, und.dst FROM reach JOIN und ON reach.r = und.src),
lab AS (SELECT node, min(r) AS component FROM reach GROUP BY node)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM lab""")
def components(fx):
    return B.components(B.cooccur_edges(type_collapsed(fx)))


@query("basket_summary", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}
SELECT (SELECT nb FROM nb) AS n_baskets, (SELECT count(DISTINCT item) FROM b) AS n_items,
  (SELECT round(avg(c), 6) FROM (SELECT count(*) AS c FROM b GROUP BY basket_id)) AS items_per_basket,
  (SELECT count(*) FROM fi) AS n_itemsets, (SELECT count(*) FROM rules) AS n_rules, (SELECT count(*) FROM kept) AS n_retained,
  (SELECT round(max(lift), 6) FROM kept) AS max_lift""")
def basket_summary(fx):
    lg = fx.baskets_type
    fi = mined(fx, "baskets_type")
    rules = B.association_rules(fi, 1.0)
    kept = B.rule_collapse(B.rule_filter(rules, **FILTER))
    per = lg.groupBy("basket_id").agg(F.count(F.lit(1)).alias("c"))
    return (per.agg(F.count(F.lit(1)).alias("n_baskets"), r(F.avg("c")).alias("items_per_basket"))
            .crossJoin(lg.agg(F.countDistinct("item").alias("n_items")))
            .crossJoin(fi.agg(F.count(F.lit(1)).alias("n_itemsets")))
            .crossJoin(rules.agg(F.count(F.lit(1)).alias("n_rules")))
            .crossJoin(kept.agg(F.count(F.lit(1)).alias("n_retained"), r(F.max("lift")).alias("max_lift"))))


@query("subset_join", f"""WITH {_items_sql('baskets_type')}, {RULES_SQL}, {COLLAPSE_SQL}
SELECT array_to_string(s.items, ' + ') AS inner_set, array_to_string(g.items, ' + ') AS outer_set,
  round(s.lift, 6) AS inner_lift, round(g.lift, 6) AS outer_lift
FROM rep s JOIN rep g ON len(g.items) > len(s.items) AND list_has_all(g.items, s.items) AND g.lift >= s.lift""")
def subset_join(fx):
    """J7 over the one-rule-per-itemset representatives (before the collapse drops them)."""
    from pyspark.sql import Window
    rules = B.rule_filter(type_rules(fx), **FILTER)
    w = Window.partitionBy("items").orderBy(F.col("lift").desc(), F.col("confidence").desc(), S.set_to_text("antecedent"))
    rep = rules.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("items", "lift")
    p = B.subset_pairs(rep, "lift")
    return p.select(S.set_to_text("inner").alias("inner_set"), S.set_to_text("outer").alias("outer_set"),
                    r("inner_lift").alias("inner_lift"), r("outer_lift").alias("outer_lift"))
