"""Checked queries for scans, projections, scalar functions, joins, aggregates, set
operations and sorts (S1, P*, J*, A*, U*, L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FE
from ..functions import scalar as S
from ..operators import order as O
from ..operators import profile as P
from ..operators import relational as R
from ..sources.sinks import nested_payload as nested
from .registry import query, r

TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_trim(x: str) -> str:
    return TRIM.format(x=x)


def sql_clean(x: str, missing: str | None = "ND") -> str:
    t = f"upper({sql_trim(x)})"
    if missing is None:
        return f"coalesce({t}, 'NAN')"
    return f"CASE WHEN {t} IS NULL OR {t} IN ('', 'NAN') THEN '{missing}' ELSE {t} END"


# ------------------------------------------------------------------ S1, P1, P2
@query("scan_table", """
SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0""")
def scan_table(fx):
    return fx.t("customer", "c_custkey", "c_acctbal", "c_mktsegment").where(F.col("c_acctbal") > 0)


@query("project_rename", """
SELECT client_id AS id, product AS segment, granted, balance FROM portfolio""")
def project_rename(fx):
    return (fx.portfolio.select("client_id", "product", "granted", "balance", "stage")
            .drop("stage").withColumnRenamed("client_id", "id").withColumnRenamed("product", "segment"))


@query("filter_pred", """
SELECT client_id, stage, prior_credits FROM portfolio
WHERE (prior_credits >= 2 AND balance > 0) OR stage = 'M3'""")
def filter_pred(fx):
    return (fx.portfolio.where(((F.col("prior_credits") >= 2) & (F.col("balance") > 0)) | (F.col("stage") == "M3"))
            .select("client_id", "stage", "prior_credits"))


# ------------------------------------------------------------------ P3-P5
@query("clean_category", f"""
SELECT client_id, {sql_clean('credit_type', None)} AS credit_type_clean, {sql_clean('sex')} AS sex_clean
FROM portfolio""")
def clean_category(fx):
    return fx.portfolio.select("client_id", S.clean_category("credit_type", None).alias("credit_type_clean"),
                               S.clean_category("sex").alias("sex_clean"))


_LQ_PARTS = []
for _pop in ("portfolio_base", "portfolio_active"):
    for _col, _miss in (("credit_type", None), ("sex", "ND")):
        _LQ_PARTS.append(f"""SELECT '{_pop}' AS population, '{_col}' AS variable,
  count(DISTINCT {_col}) AS n_raw, count(DISTINCT {sql_clean(_col, _miss)}) AS n_clean,
  array_to_string(list_sort(list_distinct(list({sql_clean(_col, _miss)}))), ',') AS levels FROM {_pop}""")


@query("level_quality", " UNION ALL ".join(_LQ_PARTS))
def level_quality(fx):
    out = None
    for pop in ("portfolio_base", "portfolio_active"):
        df = getattr(fx, pop)
        for col, miss in (("credit_type", None), ("sex", "ND")):
            part = P.level_report(df, col, S.clean_category(col, miss)).select(F.lit(pop).alias("population"), F.lit(col).alias("variable"), "n_raw", "n_clean", "levels")
            out = part if out is None else out.unionByName(part)
    return out


@query("clean_names", r"""
SELECT item, regexp_replace(regexp_replace(regexp_replace(item, '''', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS item_clean
FROM (SELECT DISTINCT item FROM baskets_type)""")
def clean_names(fx):
    return fx.baskets_type.select("item").distinct().select("item", S.clean_name("item").alias("item_clean"))


# ------------------------------------------------------------------ P6-P13
@query("ratio_clip", """
SELECT client_id,
  round(least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5), 6) AS ratio_balance,
  round(1 - least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5), 6) AS amortised
FROM portfolio""")
def ratio_clip(fx):
    ratio = S.ratio_clip("balance", "granted")
    return fx.portfolio.select("client_id", r(ratio).alias("ratio_balance"), r(1 - ratio).alias("amortised"))


@query("log_features", """
SELECT client_id, round(ln(1 + granted), 6) AS log_granted, round(ln(1 + balance), 6) AS log_balance,
       round(ln(1 + prior_credits), 6) AS log_credits FROM portfolio""")
def log_features(fx):
    return fx.portfolio.select("client_id", r(S.log1p("granted")).alias("log_granted"),
                               r(S.log1p("balance")).alias("log_balance"), r(S.log1p("prior_credits")).alias("log_credits"))


@query("per_unit_features", """
SELECT client_id, round(granted / prior_credits, 6) AS granted_per_credit, round(balance / prior_credits, 6) AS balance_per_credit,
  round(least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5) * prior_credits, 6) AS ratio_x_credits
FROM portfolio""")
def per_unit_features(fx):
    return fx.portfolio.select("client_id", r(S.per_unit("granted", "prior_credits")).alias("granted_per_credit"),
                               r(S.per_unit("balance", "prior_credits")).alias("balance_per_credit"),
                               r(S.ratio_clip("balance", "granted") * F.col("prior_credits")).alias("ratio_x_credits"))


@query("ordinal_map", """
SELECT client_id, CAST(CASE WHEN stage = 'M1' THEN 1 WHEN stage = 'M2' THEN 2 WHEN stage = 'M3' THEN 3 ELSE 1 END AS INTEGER) AS stage_num,
  CAST(CASE WHEN upper(sex) = 'M' THEN 1 WHEN upper(sex) = 'F' THEN 2 ELSE 1 END AS INTEGER) AS sex_num
FROM portfolio""")
def ordinal_map(fx):
    return fx.portfolio.select("client_id", S.ordinal_map("stage", FE.STAGE_ORDER).alias("stage_num"),
                               S.ordinal_map(F.upper("sex"), {"M": 1, "F": 2}).alias("sex_num"))


@query("threshold_flags", """
SELECT client_id, CAST(coalesce(balance <= 1, false) AS INTEGER) AS zero_balance,
  CAST(coalesce(least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5) > 0.85, false) AS INTEGER) AS high_ratio
FROM portfolio""")
def threshold_flags(fx):
    return fx.portfolio.select("client_id", S.flag(F.col("balance") <= 1).alias("zero_balance"),
                               S.flag(S.ratio_clip("balance", "granted") > 0.85).alias("high_ratio"))


@query("rel_to_group", """
WITH m AS (SELECT product, avg(nominal_rate) AS rate_mean FROM portfolio_base WHERE product IS NOT NULL GROUP BY product),
g AS (SELECT avg(nominal_rate) AS gm FROM portfolio_active)
SELECT client_id, round(nominal_rate - coalesce(rate_mean, gm), 6) AS rate_rel_product
FROM portfolio_active LEFT JOIN m USING (product), g""")
def rel_to_group(fx):
    means = FE.fit_group_means(fx.portfolio_base, "product", "nominal_rate", "rate_mean")
    res = FE.apply_group_means(fx.portfolio_active, means, "product", "nominal_rate", "rate_rel_product", "rate_mean")
    return res.select("client_id", r("rate_rel_product").alias("rate_rel_product"))


_RATIO = "least(greatest(coalesce(balance / nullif(granted, 0), 0), 0), 1.5)"


@query("build_features", f"""
WITH m AS (SELECT product, avg(nominal_rate) AS rate_mean FROM portfolio WHERE product IS NOT NULL GROUP BY product),
g AS (SELECT avg(nominal_rate) AS gm FROM portfolio)
SELECT client_id, {sql_clean('credit_type', None)} AS credit_type, {sql_clean('sex')} AS sex,
  round({_RATIO}, 6) AS ratio_balance, round(ln(1 + granted), 6) AS log_granted, round(ln(1 + balance), 6) AS log_balance,
  round(granted / prior_credits, 6) AS granted_per_credit, round(balance / prior_credits, 6) AS balance_per_credit,
  round({_RATIO} * prior_credits, 6) AS ratio_x_credits,
  CAST(CASE WHEN upper(stage) = 'M1' THEN 1 WHEN upper(stage) = 'M2' THEN 2 WHEN upper(stage) = 'M3' THEN 3 ELSE 1 END AS INTEGER) AS stage_num,
  CAST(balance <= 1 AS INTEGER) AS zero_balance, CAST({_RATIO} > 0.85 AS INTEGER) AS high_ratio,
  round(nominal_rate - coalesce(rate_mean, gm), 6) AS rate_rel_product
FROM portfolio LEFT JOIN m USING (product), g""")
def build_features(fx):
    d, _ = FE.build_features(fx.portfolio)
    rd = ["ratio_balance", "log_granted", "log_balance", "granted_per_credit", "balance_per_credit",
          "ratio_x_credits", "rate_rel_product"]
    return d.select("client_id", "credit_type", "sex", *[r(c).alias(c) for c in rd], "stage_num", "zero_balance", "high_ratio")


@query("binary_label", """
SELECT client_id, CAST(status = 'Retired' AS INTEGER) AS y_status FROM portfolio""")
def binary_label(fx):
    return fx.portfolio.select("client_id", S.flag(F.col("status") == "Retired").alias("y_status"))


# ------------------------------------------------------------------ P14-P24
GRANTED_EDGES = [0.0, 1e6, 2e6, 4e6, 1e7]
GRANTED_LABELS = ["a_low", "b_mid", "c_high", "d_top"]


@query("cut_bins", """
SELECT CASE WHEN granted > 0 AND granted <= 1000000 THEN 'a_low' WHEN granted > 1000000 AND granted <= 2000000 THEN 'b_mid'
            WHEN granted > 2000000 AND granted <= 4000000 THEN 'c_high' WHEN granted > 4000000 AND granted <= 10000000 THEN 'd_top' END AS bin,
       count(*) AS n
FROM portfolio GROUP BY 1""")
def cut_bins(fx):
    return (fx.portfolio.select(S.cut_bins("granted", GRANTED_EDGES, GRANTED_LABELS).alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


@query("clip_upper", """
SELECT least(prior_credits, 12) AS credits_capped, count(*) AS n, round(avg(y), 6) AS rate
FROM portfolio GROUP BY 1""")
def clip_upper(fx):
    return (fx.portfolio.groupBy(S.clip_upper("prior_credits", 12).alias("credits_capped"))
            .agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate")))


@query("clip_prob", """
SELECT client_id, round(least(greatest(p * 1.2 - 0.1, 0.0001), 0.9999), 6) AS p_clipped FROM scored""")
def clip_prob(fx):
    return fx.scored.select("client_id", r(S.clip_range(F.col("p") * 1.2 - 0.1, 1e-4, 1 - 1e-4)).alias("p_clipped"))


@query("key_arithmetic", """
SELECT round(avg(CAST(loan_id = client_id * 10 AS INTEGER)), 6) AS share_loan_rule,
       round(avg(CAST(loan_id % 10 = 0 AS INTEGER)), 6) AS share_integer_tenth,
       round(avg(CAST(client_id % 2 = 0 AS INTEGER)), 6) AS share_even FROM portfolio""")
def key_arithmetic(fx):
    p = fx.portfolio
    return p.agg(r(F.avg((F.col("loan_id") == F.col("client_id") * 10).cast("int"))).alias("share_loan_rule"),
                 r(F.avg((F.col("loan_id") % 10 == 0).cast("int"))).alias("share_integer_tenth"),
                 r(F.avg((F.col("client_id") % 2 == 0).cast("int"))).alias("share_even"))


SIG_COLS = ["product", "credit_type", "sex", "stage", "region", "prior_credits"]
SIG_SQL = ("CAST(('0x' || substr(md5(" + " || '|' || ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in SIG_COLS) + "), 1, 12)) AS BIGINT)")


@query("row_signature", f"SELECT client_id, {SIG_SQL} AS group_id FROM portfolio")
def row_signature(fx):
    return fx.portfolio.select("client_id", S.row_signature(SIG_COLS).alias("group_id"))


@query("conditional_label", """
SELECT client_id, CASE WHEN p > 0.5 THEN 'Yes' ELSE 'No' END AS high_risk FROM scored""")
def conditional_label(fx):
    return fx.scored.select("client_id", S.conditional_label(F.col("p") > 0.5).alias("high_risk"))


@query("round_present", """
SELECT client_id, round_even(p * 100.0, 0) / 100.0 AS p2, round_even(p * 100 * 1.0, 0) / 1.0 AS pct0 FROM scored""")
def round_present(fx):
    return fx.scored.select("client_id", S.round_half_even("p", 2).alias("p2"),
                            S.round_half_even(F.col("p") * 100, 0).alias("pct0"))


@query("strip_prefix", r"""
SELECT regexp_replace(o_orderpriority, '^[0-9]+b?[.\-]\s*', '') AS priority, count(*) AS n FROM orders GROUP BY 1""")
def strip_prefix(fx):
    return (fx.t("orders", "o_orderpriority").groupBy(S.strip_prefix("o_orderpriority").alias("priority"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("lookup_names", """
SELECT client_id, coalesce(r_name, 'Unknown') AS region_name FROM portfolio LEFT JOIN region ON region = r_regionkey""")
def lookup_names(fx):
    reg = fx.t("region", "r_regionkey", "r_name")
    p = fx.portfolio
    return (p.join(reg, p.region == reg.r_regionkey, "left")
            .select("client_id", F.coalesce("r_name", F.lit("Unknown")).alias("region_name")))


@query("set_to_text", """
SELECT basket_id, string_agg(item, ' + ' ORDER BY item) AS itemset, count(*) AS n_items FROM baskets_type GROUP BY basket_id""")
def set_to_text(fx):
    return (fx.baskets_type.groupBy("basket_id").agg(F.collect_list("item").alias("items"))
            .select("basket_id", S.set_to_text("items").alias("itemset"), F.size("items").cast("long").alias("n_items")))


# ------------------------------------------------------------------ joins
@query("left_join_keys", """
WITH f AS (SELECT client_id, loan_id, round(balance / granted, 6) AS ratio FROM portfolio_active)
SELECT a.client_id, a.loan_id, a.product, f.ratio FROM portfolio_active a LEFT JOIN f USING (client_id, loan_id)""")
def left_join_keys(fx):
    a = fx.portfolio_active
    f = a.select("client_id", "loan_id", r(F.try_divide(F.col("balance"), F.col("granted"))).alias("ratio"))
    return R.left_join_checked(a.select("client_id", "loan_id", "product"), f, ["client_id", "loan_id"], not_null=["ratio"])


@query("inner_join", """
SELECT client_id, n_name FROM portfolio JOIN nation ON branch = n_nationkey""")
def inner_join(fx):
    n = fx.t("nation", "n_nationkey", "n_name")
    p = fx.portfolio
    return p.join(n, p.branch == n.n_nationkey, "inner").select("client_id", "n_name")


@query("index_join", """
WITH a AS (SELECT product, count(*) AS n_hist, round(avg(y), 6) AS rate FROM portfolio_base GROUP BY product),
b AS (SELECT product, count(*) AS n_active, round(avg(balance), 6) AS mean_balance_active FROM portfolio_active GROUP BY product)
SELECT * FROM a LEFT JOIN b USING (product)""")
def index_join(fx):
    a = fx.portfolio_base.groupBy("product").agg(F.count(F.lit(1)).alias("n_hist"), r(F.avg("y")).alias("rate"))
    b = fx.portfolio_active.groupBy("product").agg(F.count(F.lit(1)).alias("n_active"),
                                                   r(F.avg("balance")).alias("mean_balance_active"))
    return a.join(b, "product", "left")


@query("outer_align", """
WITH a AS (SELECT prior_credits AS level, CAST(count(*) AS DOUBLE) AS hist FROM portfolio_base GROUP BY 1),
b AS (SELECT prior_credits AS level, CAST(count(*) AS DOUBLE) AS pred FROM portfolio_active GROUP BY 1)
SELECT coalesce(a.level, b.level) AS level, coalesce(hist, 0) AS hist, coalesce(pred, 0) AS pred
FROM a FULL OUTER JOIN b ON a.level = b.level""")
def outer_align(fx):
    a = fx.portfolio_base.groupBy(F.col("prior_credits").alias("level")).agg(F.count(F.lit(1)).cast("double").alias("hist"))
    b = fx.portfolio_active.groupBy(F.col("prior_credits").alias("level")).agg(F.count(F.lit(1)).cast("double").alias("pred"))
    return R.outer_align(a, b, "level", "hist", "pred", fill=0.0)


@query("semi_cover", """
SELECT round(avg(CASE WHEN branch IN (SELECT branch FROM portfolio_base WHERE prior_credits >= 10) THEN 1.0 ELSE 0.0 END), 6) AS cover
FROM portfolio_active""")
def semi_cover(fx):
    other = fx.portfolio_base.where(F.col("prior_credits") >= 10)
    return R.semi_cover(fx.portfolio_active, other, "branch").select(r("cover").alias("cover"))


@query("membership_split", f"""
WITH g AS (SELECT DISTINCT {SIG_SQL} AS gid FROM portfolio_base WHERE y = 1)
SELECT client_id FROM portfolio_active WHERE {SIG_SQL} IN (SELECT gid FROM g)""")
def membership_split(fx):
    g = fx.portfolio_base.where("y = 1").select(S.row_signature(SIG_COLS).alias("gid")).distinct()
    a = fx.portfolio_active.withColumn("gid", S.row_signature(SIG_COLS))
    return a.join(g, "gid", "left_semi").select("client_id")


@query("scenario_cross", """
WITH k AS (SELECT * FROM (VALUES (0.1), (0.2), (0.3)) t(eff))
SELECT CAST(eff AS DOUBLE) AS eff, count(*) AS n_selected
FROM scored, k WHERE p * CAST(eff AS DOUBLE) * granted / 1000 - 25 > 0 GROUP BY eff""")
def scenario_cross(fx):
    k = fx.spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "eff double")
    return (R.scenario_cross(fx.scored, k).where(F.col("p") * F.col("eff") * F.col("granted") / 1000 - 25 > 0)
            .groupBy("eff").agg(F.count(F.lit(1)).alias("n_selected")))


# ------------------------------------------------------------------ aggregates
@query("group_stats", """
SELECT product, count(*) AS n, round(avg(granted), 6) AS mean_granted, round(sum(balance), 2) AS sum_balance,
  min(prior_credits) AS min_credits, max(prior_credits) AS max_credits, round(median(balance), 6) AS median_balance,
  round(avg(CAST(y AS DOUBLE)), 6) AS rate, round(avg(CASE WHEN prior_credits = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_first
FROM portfolio WHERE product IS NOT NULL GROUP BY product""")
def group_stats(fx):
    p = fx.portfolio.where(F.col("product").isNotNull())
    g = p.groupBy("product").agg(F.count(F.lit(1)).alias("n"), r(F.avg("granted")).alias("mean_granted"),
                                 r(F.sum("balance"), 2).alias("sum_balance"), F.min("prior_credits").alias("min_credits"),
                                 F.max("prior_credits").alias("max_credits"), r(F.avg("y")).alias("rate"),
                                 r(F.avg((F.col("prior_credits") == 1).cast("double"))).alias("share_first"))
    med = R.grouped_median(p, ["product"], "balance", "median_balance")
    return g.join(med, "product").withColumn("median_balance", r("median_balance"))


@query("global_stats", """
SELECT count(*) AS n, round(avg(granted), 6) AS mean_granted, round(median(granted), 6) AS median_granted,
  min(granted) AS min_granted, max(granted) AS max_granted, count(*) FILTER (WHERE balance = 0) AS n_zero_balance,
  round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM portfolio""")
def global_stats(fx):
    p = fx.portfolio
    med = O.exact_quantiles(p, "granted", [0.5]).select(r("value").alias("median_granted"))
    g = p.agg(F.count(F.lit(1)).alias("n"), r(F.avg("granted")).alias("mean_granted"), F.min("granted").alias("min_granted"),
              F.max("granted").alias("max_granted"), F.count_if(F.col("balance") == 0).alias("n_zero_balance"),
              r(F.avg("y")).alias("rate"))
    return g.crossJoin(med)


DESC_COLS = ["granted", "balance", "nominal_rate", "prior_credits", "acctbal"]


@query("describe_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM portfolio""" for c in DESC_COLS))
def describe_numeric(fx):
    d = R.describe_numeric(fx.portfolio, DESC_COLS)
    return d.select("variable", "count", *[r(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


PROFILE_COLS = ["client_id", "region", "product", "credit_type", "sex", "granted", "balance", "stage", "prior_credits", "status"]
_NUMERIC_PROFILE = {"client_id", "region", "granted", "balance", "prior_credits"}
# the active population's table carries no outcome column (it is what gets predicted)
_ACTIVE_COLS = [c for c in PROFILE_COLS if c not in ("status", "y")]


def _profile_sql():
    parts = []
    for c in PROFILE_COLS:
        ex_num = f"round(CAST(min({c}) AS DOUBLE), 6)" if c in _NUMERIC_PROFILE else "CAST(NULL AS DOUBLE)"
        ex_txt = "CAST(NULL AS VARCHAR)" if c in _NUMERIC_PROFILE else f"min({c})"
        parts.append(f"""SELECT '{c}' AS variable, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
  count(DISTINCT {c}) AS n_distinct, {ex_num} AS example_num, {ex_txt} AS example_text,
  {'true' if c in _ACTIVE_COLS else 'false'} AS in_other FROM portfolio""")
    return " UNION ALL ".join(parts)


@query("profile_columns", _profile_sql())
def profile_columns(fx):
    """A4: type-free column dictionary of the labelled table; ``in_other`` compares its
    schema with the active population's (which has no outcome column)."""
    other = set(fx.portfolio_active.drop("status", "y").columns)   # schema only, no data pass
    p = P.column_profile(fx.portfolio, PROFILE_COLS)
    return p.select("variable", r("null_share").alias("null_share"), "n_distinct", r("example_num").alias("example_num"), "example_text",
                    F.col("variable").isin(*other).alias("in_other"))


@query("value_counts", """
SELECT product, count(*) AS n, round(count(*) / (SELECT count(product) FROM portfolio), 6) AS share
FROM portfolio WHERE product IS NOT NULL GROUP BY product""")
def value_counts(fx):
    return R.value_counts(fx.portfolio, "product").withColumn("share", r("share"))


@query("distinct_count", """
SELECT count(DISTINCT client_id) AS n_clients, count(*) AS n_rows,
  (SELECT count(*) FROM (SELECT DISTINCT product, stage FROM portfolio)) AS n_combos FROM portfolio""")
def distinct_count(fx):
    p = fx.portfolio
    combos = p.select("product", "stage").distinct().agg(F.count(F.lit(1)).alias("n_combos"))
    return p.agg(F.countDistinct("client_id").alias("n_clients"), F.count(F.lit(1)).alias("n_rows")).crossJoin(combos)


STAGES = ["M1", "M2", "M3"]


@query("crosstab_n", "SELECT product, " + ", ".join(
    f"count(*) FILTER (WHERE stage = '{s}') AS {s}" for s in STAGES) + " FROM portfolio GROUP BY product")
def crosstab_n(fx):
    return R.crosstab(fx.portfolio, "product", "stage", STAGES)


@query("crosstab_agg", "SELECT product, " + ", ".join(
    f"round(coalesce(sum(balance) FILTER (WHERE stage = '{s}'), 0), 2) AS {s}" for s in STAGES)
       + " FROM portfolio GROUP BY product")
def crosstab_agg(fx):
    ct = R.crosstab(fx.portfolio, "product", "stage", STAGES, value="balance", agg="sum")
    return ct.select("product", *[r(s, 2).alias(s) for s in STAGES])


@query("crosstab_mean", "SELECT product, " + ", ".join(
    f"round(avg(granted) FILTER (WHERE stage = '{s}'), 6) AS {s}" for s in STAGES)
       + " FROM portfolio GROUP BY product")
def crosstab_mean(fx):
    ct = R.crosstab(fx.portfolio, "product", "stage", STAGES, value="granted", agg="mean")
    return ct.select("product", *[r(s).alias(s) for s in STAGES])


@query("crosstab_norm", """
WITH c AS (SELECT CAST(prior_credits >= 5 AS INTEGER) AS many, stage, count(*) AS n FROM portfolio GROUP BY 1, 2),
t AS (SELECT stage, sum(n) AS tot FROM c GROUP BY stage)
SELECT many, """ + ", ".join(f"round(coalesce(sum(n) FILTER (WHERE c.stage = '{s}') / max(tot) FILTER (WHERE c.stage = '{s}'), 0), 6) AS {s}" for s in STAGES)
       + " FROM c JOIN t USING (stage) GROUP BY many")
def crosstab_norm(fx):
    d = fx.portfolio.withColumn("many", (F.col("prior_credits") >= 5).cast("int"))
    ct = R.crosstab(d, "many", "stage", STAGES, normalize_columns=True)
    return ct.select("many", *[r(F.coalesce(F.col(s), F.lit(0.0))).alias(s) for s in STAGES])


@query("index_vs_global", """
WITH g AS (SELECT avg(granted) AS g_granted, avg(balance) AS g_balance, avg(CAST(y AS DOUBLE)) AS g_rate FROM portfolio),
p AS (SELECT product, avg(granted) AS granted, avg(balance) AS balance, avg(CAST(y AS DOUBLE)) AS rate FROM portfolio GROUP BY product)
SELECT product, round(100 * granted / g_granted, 6) AS idx_granted, round(100 * balance / g_balance, 6) AS idx_balance,
       round(100 * rate / g_rate, 6) AS idx_rate FROM p, g""")
def index_vs_global(fx):
    p = fx.portfolio
    cols = ["granted", "balance", "rate"]
    grp = p.groupBy("product").agg(F.avg("granted").alias("granted"), F.avg("balance").alias("balance"), F.avg("y").alias("rate"))
    glob = p.agg(F.avg("granted").alias("granted"), F.avg("balance").alias("balance"), F.avg("y").alias("rate"))
    res = R.index_vs_global(grp, glob, cols)
    return res.select("product", *[r(f"idx_{c}").alias(f"idx_{c}") for c in cols])


@query("share_of_total", """
WITH s AS (SELECT product, sum(balance) AS balance FROM portfolio GROUP BY product)
SELECT product, round(balance, 2) AS balance, round(100 * balance / sum(balance) OVER (), 6) AS share_pct FROM s""")
def share_of_total(fx):
    s = fx.portfolio.groupBy("product").agg(F.sum("balance").alias("balance"))
    return R.share_of_total(s, "balance").select("product", r("balance", 2).alias("balance"), r("share_pct").alias("share_pct"))


QS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query("quantiles", " UNION ALL ".join(
    f"SELECT '{pop}' AS population, CAST({q} AS DOUBLE) AS q, round(quantile_cont(granted, {q}), 6) AS value FROM {pop}"
    for pop in ("portfolio_base", "portfolio_active") for q in QS))
def quantiles(fx):
    both = (fx.portfolio_base.withColumn("population", F.lit("portfolio_base"))
            .unionByName(fx.portfolio_active.withColumn("population", F.lit("portfolio_active"))))
    return O.exact_quantiles(both, "granted", QS, by=["population"]).select("population", "q", r("value").alias("value"))


@query("histogram", """
WITH b AS (SELECT CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM scored WHERE p >= 0 AND p <= 1 GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(CAST(i AS DOUBLE) * 0.05, 6) AS lo, round(CAST(i + 1 AS DOUBLE) * 0.05, 6) AS hi
FROM range(20) t(i) LEFT JOIN b ON b.bin = i""")
def histogram(fx):
    h = R.histogram(fx.scored, "p", 20)
    return h.select("bin", "n", r("lo").alias("lo"), r("hi").alias("hi"))


@query("pearson", """
SELECT round(corr(granted, balance), 6) AS corr_granted_balance, round(corr(prior_credits, granted), 6) AS corr_credits_granted
FROM portfolio""")
def pearson(fx):
    return fx.portfolio.agg(r(F.corr("granted", "balance")).alias("corr_granted_balance"),
                            r(F.corr(F.col("prior_credits").cast("double"), "granted")).alias("corr_credits_granted"))


@query("top_groups", """
SELECT branch, count(*) AS n, round(sum(balance), 2) AS total FROM portfolio GROUP BY branch ORDER BY sum(balance) DESC, branch LIMIT 5""")
def top_groups(fx):
    return R.top_groups(fx.portfolio, "branch", "balance", 5).withColumn("total", r("total", 2))


@query("row_item_count", """
WITH c AS (SELECT basket_id, count(*) AS n_items FROM baskets_brand GROUP BY basket_id)
SELECT n_items, count(*) AS baskets FROM c GROUP BY n_items""")
def row_item_count(fx):
    c = fx.baskets_brand.groupBy("basket_id").agg(F.count(F.lit(1)).alias("n_items"))
    return c.groupBy("n_items").agg(F.count(F.lit(1)).alias("baskets"))


# ------------------------------------------------------------------ set operations
@query("key_overlap", """
SELECT count(*) AS overlap FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00')""")
def key_overlap(fx):
    c = fx.t("customer", "c_custkey").select(F.col("c_custkey").alias("k"))
    o = fx.t("orders", "o_custkey", "o_orderdate").where(F.col("o_orderdate") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")) \
        .select(F.col("o_custkey").alias("k"))
    return R.key_overlap(c, o, "k")


@query("new_levels", """
SELECT prior_credits AS level FROM portfolio_active EXCEPT SELECT prior_credits FROM portfolio_base WHERE prior_credits <= 12""")
def new_levels(fx):
    a = fx.portfolio_base.where("prior_credits <= 12").select(F.col("prior_credits").alias("level"))
    b = fx.portfolio_active.select(F.col("prior_credits").alias("level"))
    return R.new_levels(a, b, "level")


@query("union_results", """
SELECT 'base' AS population, count(*) AS n, round(avg(granted), 6) AS mean_granted FROM portfolio_base
UNION ALL SELECT 'active', count(*), round(avg(granted), 6) FROM portfolio_active""")
def union_results(fx):
    a = fx.portfolio_base.agg(F.lit("base").alias("population"), F.count(F.lit(1)).alias("n"), r(F.avg("granted")).alias("mean_granted"))
    b = fx.portfolio_active.agg(F.lit("active").alias("population"), F.count(F.lit(1)).alias("n"), r(F.avg("granted")).alias("mean_granted"))
    return a.unionByName(b)


@query("dup_rows", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM portfolio GROUP BY product, stage, sex, region)""")
def dup_rows(fx):
    return R.duplicate_rows(fx.portfolio, ["product", "stage", "sex", "region"])


@query("dedupe_best", """
SELECT product, client_id, round(balance, 6) AS balance FROM (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY balance DESC, client_id) AS rn FROM portfolio) WHERE rn = 1""")
def dedupe_best(fx):
    d = R.dedupe_best_agg(fx.portfolio, ["product"], [("balance", False), ("client_id", True)])
    return d.select("product", "client_id", r("balance").alias("balance"))


@query("tables_equal", """
WITH c AS (
SELECT 'self' AS pair, (SELECT count(*) FROM (SELECT * FROM portfolio EXCEPT ALL SELECT * FROM portfolio)) AS only_a,
       (SELECT count(*) FROM (SELECT * FROM portfolio EXCEPT ALL SELECT * FROM portfolio)) AS only_b
UNION ALL
SELECT 'filtered', (SELECT count(*) FROM (SELECT * FROM portfolio EXCEPT ALL SELECT * FROM portfolio_base)),
       (SELECT count(*) FROM (SELECT * FROM portfolio_base EXCEPT ALL SELECT * FROM portfolio)))
SELECT pair, only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM c""")
def tables_equal(fx):
    a = R.tables_equal(fx.portfolio, fx.portfolio).select(F.lit("self").alias("pair"), "only_a", "only_b", "equal")
    b = R.tables_equal(fx.portfolio, fx.portfolio_base).select(F.lit("filtered").alias("pair"), "only_a", "only_b", "equal")
    return a.unionByName(b)


@query("format_cells", """
SELECT client_id, format('{:.1f}', p * 100) || '%' AS share, format('{:,.0f}', granted) AS amount FROM scored""")
def format_cells(fx):
    return fx.scored.select("client_id", S.format_pct("p").alias("share"), S.format_thousands("granted").alias("amount"))


@query("nested_payload", """
WITH a AS (SELECT product, count(*) AS n FROM portfolio GROUP BY product), b AS (SELECT stage, sex, count(*) AS n FROM portfolio GROUP BY stage, sex)
SELECT CAST(to_json({'by_product': (SELECT list({'product': product, 'n': n} ORDER BY product, n) FROM a),
                     'by_stage': (SELECT list({'stage': stage, 'sex': sex, 'n': n} ORDER BY stage, sex, n) FROM b)}) AS VARCHAR) AS payload""")
def nested_payload(fx):
    n = F.count(F.lit(1)).alias("n")
    return nested({"by_product": fx.portfolio.groupBy("product").agg(n), "by_stage": fx.portfolio.groupBy("stage", "sex").agg(n)})


@query("sequence_check", """
WITH rk AS (SELECT row_number() OVER (ORDER BY p DESC, client_id) AS k FROM scored)
SELECT min(k) = 1 AND max(k) = count(*) AND count(DISTINCT k) = count(*) AS is_sequence, count(*) AS n FROM rk""")
def sequence_check(fx):
    rk = O.global_rank(fx.scored, "p", "client_id", out="k")
    return R.sequence_check(rk, "k")


# ------------------------------------------------------------------ sorts and limits
@query("sort_multi", """
SELECT product, client_id, round(balance, 6) AS balance FROM portfolio ORDER BY product, balance DESC, client_id""")
def sort_multi(fx):
    return (fx.portfolio.orderBy(F.col("product"), F.col("balance").desc(), F.col("client_id"))
            .select("product", "client_id", r("balance").alias("balance")))


@query("limit_head", """
SELECT client_id, granted FROM portfolio ORDER BY granted DESC, client_id LIMIT 10""")
def limit_head(fx):
    return fx.portfolio.orderBy(F.col("granted").desc(), F.col("client_id")).limit(10).select("client_id", "granted")


@query("topk", """
SELECT client_id, p FROM scored ORDER BY p DESC, client_id LIMIT 25""")
def topk(fx):
    return R.topk(fx.scored, "p", "client_id", 25).select("client_id", "p")


@query("topk_stats", """
WITH rk AS (SELECT *, row_number() OVER (ORDER BY p DESC, client_id) AS rk FROM scored),
k AS (SELECT * FROM (VALUES (50), (100), (200)) t(K))
SELECT CAST(K AS BIGINT) AS K, round(avg(p), 6) AS mean_p, CAST(sum(y) AS BIGINT) AS positives, round(sum(balance), 2) AS balance
FROM rk, k WHERE rk <= K GROUP BY K""")
def topk_stats(fx):
    res = R.topk_stats(fx.scored, "p", "client_id", [50, 100, 200],
                       [r(F.avg("p")).alias("mean_p"), F.sum("y").cast("long").alias("positives"), r(F.sum("balance"), 2).alias("balance")])
    return res


@query("sample_seeded", """
SELECT client_id FROM portfolio ORDER BY md5(CAST(client_id AS VARCHAR) || '|42') LIMIT 100""")
def sample_seeded(fx):
    return R.sample_seeded(fx.portfolio, "client_id", 100, seed=42).select("client_id")
