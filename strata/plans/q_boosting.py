"""Checked queries for leaf-wise boosting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import metrics as E
from ..session import materialize
from .q_models import CATS, LEAFWISE, NUMS, WITHOUT_BALANCE, boosted_folds, modelable, train_folds
from .registry import query, r

BIN_NUMS = ["granted", "balance", "acctbal", "prior_credits"]
BIN_SIZE = 18      # 16 edges at k / 17

_LONG = " UNION ALL ".join(f"SELECT {i} AS f, '{c}' AS variable, CAST({'nullif(balance, 0)' if c == 'balance' else c} AS DOUBLE) AS v, y FROM portfolio"
                           for i, c in enumerate(BIN_NUMS))
_EDGES = ", ".join(repr(i / (BIN_SIZE - 1)) for i in range(1, BIN_SIZE - 1))
_BINNED = f"""
l AS ({_LONG}),
e AS (SELECT variable, list_distinct(quantile_cont(v, [{_EDGES}])) AS edges FROM l GROUP BY variable),
b AS (SELECT f, variable, CASE WHEN v IS NULL THEN 0 ELSE 1 + len(list_filter(edges, lambda x: x < v)) END AS bin, count(*) AS n, sum(y) AS n_pos
  FROM l JOIN e USING (variable) GROUP BY ALL)"""


def _bin_rows(fx):
    """Numbers with missing values (a zero balance counts as missing) and the label."""
    return fx.portfolio.select("client_id", "y", *[F.when(F.col(c) != 0, F.col(c)).alias(c) if c == "balance" else F.col(c) for c in BIN_NUMS])


@query("boost_bins", f"""
WITH {_BINNED}
SELECT variable, CAST(bin AS INTEGER) AS bin, n, CAST(n_pos AS BIGINT) AS n_pos FROM b""")
def boost_bins(fx):
    d = _bin_rows(fx)
    return B.bin_counts(d, B.fit_bins(d, [], BIN_NUMS, BIN_SIZE))


@query("boost_first_split", f"""
WITH {_BINNED},
t AS (SELECT count(*) AS tn, avg(CAST(y AS DOUBLE)) AS p FROM portfolio),
c AS (SELECT f, s.bin AS cut, o.with_missing, sum(CASE WHEN b.bin <= s.bin AND (b.bin > 0 OR o.with_missing = 1) THEN b.n ELSE 0 END) AS ln,
    sum(CASE WHEN b.bin <= s.bin AND (b.bin > 0 OR o.with_missing = 1) THEN b.n_pos ELSE 0 END) AS lp
  FROM b CROSS JOIN (SELECT unnest(range(0, {BIN_SIZE - 1})) AS bin) s CROSS JOIN (SELECT unnest([0, 1]) AS with_missing) o GROUP BY ALL),
g AS (SELECT *, ln * p - lp AS lg, (tn - ln) * p - (tn * p - lp) AS rg, ln * p * (1 - p) AS lh, (tn - ln) * p * (1 - p) AS rh FROM c, t
  WHERE ln >= {LEAFWISE.min_child} AND tn - ln >= {LEAFWISE.min_child}),
s AS (SELECT *, power(greatest(abs(lg) - {LEAFWISE.alpha}, 0), 2) / (lh + {LEAFWISE.lam})
    + power(greatest(abs(rg) - {LEAFWISE.alpha}, 0), 2) / (rh + {LEAFWISE.lam}) AS gain FROM g)
SELECT round(max(gain), 2) AS gain FROM s HAVING max(gain) > 1e-9""")
def boost_first_split(fx):
    """The gain of the root split of the first tree, over all features and cuts."""
    d = _bin_rows(fx)
    s = B.Settings(rounds=0, max_bins=BIN_SIZE, min_child=LEAFWISE.min_child)
    gain = B.root_split(B.fit(d, [], BIN_NUMS, "client_id", settings=s), s)
    return fx.spark.createDataFrame([(gain,)] if gain is not None else [], "gain double").select(r("gain", 2).alias("gain"))


@query("leafwise_boost")
def leafwise_boost(fx):
    """Rows-only: scores of the test block by a model of the training block."""
    d = modelable(fx, True)
    m = B.fit(d.where("split = 'train'"), CATS, NUMS, "client_id", settings=LEAFWISE)
    return m.predict(d.where("split = 'test'"), ["client_id"]).select("client_id", r("score").alias("score"))


@query("boost_folds")
def boost_folds(fx):
    """Rows-only: boosting and its ablation, out of fold, all metrics."""
    oof = materialize(boosted_folds(train_folds(fx), {"gbt": NUMS, "ablation": WITHOUT_BALANCE}))
    return E.evaluate(oof, "gbt", "y", "client_id", "boosting (oof)") \
        .unionByName(E.evaluate(oof, "ablation", "y", "client_id", "boosting without balance family"))
