"""Query registry: every checked operator has a Spark plan and (where SQL can say it)
a DuckDB twin over the same parquet views. ``__spark_entry__`` only wires this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import CONTRIB_WEIGHTS, CUTOFF, SHIP_CUTOFF, STATUS_RENEWED, STATUS_RETIRED, URGENT, Fixtures

DIGITS = 6   # rounding convention for computed doubles on both sides

REGISTRY: dict[str, tuple[Callable[[Fixtures], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r(c: Column | str, d: int = DIGITS) -> Column:
    """Spark side of the rounding convention."""
    return F.round(F.col(c) if isinstance(c, str) else c, d)


_urg = ", ".join(f"'{u}'" for u in URGENT)
_contrib_means = ", ".join(f"avg({c}) AS m_{c}" for c in CONTRIB_WEIGHTS)
_contrib_rows = " UNION ALL ".join(
    f"SELECT client_id, client_id % 5 AS fold, '{c}' AS variable, CAST({c} AS DOUBLE) AS value, "
    f"CAST({w} AS DOUBLE) * (CAST({c} AS DOUBLE) - m_{c}) AS contribution FROM portfolio, contrib_means"
    for c, w in CONTRIB_WEIGHTS.items())

PRELUDE = f"""
past AS (
  SELECT o_custkey, count(*) AS prior_credits, sum(o_totalprice) AS granted,
         sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END) AS balance,
         avg(CASE WHEN o_orderpriority IN ({_urg}) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS urgent_share
  FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}' GROUP BY o_custkey),
later AS (SELECT DISTINCT o_custkey AS later_key FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'),
portfolio AS (
  SELECT c_custkey AS client_id, c_custkey * 10 AS loan_id, CAST(n_regionkey AS BIGINT) AS region,
         CAST(c_nationkey AS BIGINT) AS branch, c_mktsegment AS product,
         CASE WHEN c_custkey % 97 = 0 THEN ''
              WHEN c_custkey % 3 = 0 THEN ' ' || lower(c_mktsegment) || ' '
              WHEN c_custkey % 3 = 1 THEN c_mktsegment || '  '
              ELSE c_mktsegment END AS credit_type,
         CAST(12 AS DOUBLE) + CAST(24 AS DOUBLE) * urgent_share AS nominal_rate,
         CASE WHEN c_custkey % 41 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'M' END AS sex,
         granted, balance,
         CASE WHEN balance / granted < 0.34 THEN 'M1' WHEN balance / granted < 0.67 THEN 'M2' ELSE 'M3' END AS stage,
         prior_credits,
         CASE WHEN later_key IS NULL THEN '{STATUS_RETIRED}' ELSE '{STATUS_RENEWED}' END AS status,
         CAST(later_key IS NULL AS INTEGER) AS y,
         c_acctbal AS acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN past ON c_custkey = past.o_custkey
       LEFT JOIN later ON c_custkey = later_key),
portfolio_base AS (SELECT * FROM portfolio WHERE client_id % 5 <> 0),
portfolio_active AS (SELECT * FROM portfolio WHERE client_id % 5 = 0),
ship_all AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_shipdate, l_returnflag FROM lineitem),
ship_base AS (SELECT * FROM ship_all WHERE l_shipdate < TIMESTAMP '{SHIP_CUTOFF}'),
ship_active AS (SELECT * FROM ship_all WHERE l_shipdate >= TIMESTAMP '{SHIP_CUTOFF}'),
scored AS (SELECT *, CAST(((floor(acctbal) + 1000) % 997 + 1) / 1000.0 AS DOUBLE) AS p FROM portfolio),
baskets_brand AS (SELECT DISTINCT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
baskets_type AS (SELECT DISTINCT l_orderkey AS basket_id, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
contrib_means AS (SELECT {_contrib_means} FROM portfolio),
contrib AS ({_contrib_rows}),
emb_long AS (
  SELECT vec_id, label AS cluster, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, label, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings))
"""


def with_prelude(body: str) -> str:
    b = body.strip()
    if b[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + PRELUDE + ", " + b[14:]
    if b[:4].upper() == "WITH":
        return "WITH " + PRELUDE + ", " + b[4:]
    return "WITH " + PRELUDE + " " + b


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    out = {}
    for name, (fn, _sql) in REGISTRY.items():
        out[name] = (lambda f: (lambda spark, sf_dir: f(Fixtures(spark, sf_dir))))(fn)
    return out


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_prelude(sql) for name, (_fn, sql) in REGISTRY.items() if sql}


def _load():
    # importing the query modules fills REGISTRY
    from . import q_relational, q_order, q_audit, q_campaign, q_baskets, q_segments, q_models, q_boosting, q_storage  # noqa: F401
