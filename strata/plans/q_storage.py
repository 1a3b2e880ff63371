"""Checked queries for sources and sinks (S2-S8, U3): derived tables are written below the shared folder of the
cluster and read back, so both directions are compared with SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import relational as R
from ..session import scratch_path
from ..sources import sinks, tables
from .registry import query, r


def _path(fx, name: str) -> str:
    return scratch_path(fx.spark, f"{name}-{uuid.uuid4().hex}")


CLIENTS = ("client_id", "product", "prior_credits", "balance", "y")


@query("scan_delimited", "SELECT client_id, product, prior_credits, round(balance, 6) AS balance, y FROM portfolio")
def scan_delimited(fx):
    """A ';' file with a header, read with its declared schema."""
    df, path = fx.portfolio.select(*CLIENTS), _path(fx, "delimited")
    df.write.option("sep", ";").option("header", True).csv(path)
    return tables.scan_delimited(fx.spark, path, df.schema).withColumn("balance", r("balance"))


@query("scan_stage", "SELECT client_id, product, prior_credits, round(balance, 6) AS balance, y FROM portfolio WHERE stage = 'M1'")
def scan_stage(fx):
    """S3: a stage table in folders by stage; the filter reads one folder."""
    path = sinks.sink_table(fx.portfolio.select(*CLIENTS, "stage"), _path(fx, "stage"), partition_by=["stage"])
    return tables.scan_stage(fx.spark, path).where("stage = 'M1'").select(*CLIENTS).withColumn("balance", r("balance"))


@query("sink_table", """
SELECT stage, count(*) AS n, round(sum(balance), 2) AS balance, count(DISTINCT product) AS products FROM portfolio GROUP BY stage""")
def sink_table(fx):
    """Written as CSV with header, counted from the files."""
    df = fx.portfolio.select(*CLIENTS, "stage")
    path = sinks.sink_table(df, _path(fx, "table"), fmt="csv")
    back = tables.scan_stage(fx.spark, path, fmt="csv", schema=df.schema)
    return back.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), r(F.sum("balance"), 2).alias("balance"), F.countDistinct("product").alias("products"))


SUMMARY_SQL = """
SELECT count(*) AS clients, CAST(sum(y) AS BIGINT) AS churned, round(avg(CAST(y AS DOUBLE)), 6) AS rate, round(sum(balance), 2) AS balance FROM portfolio"""


def _summary(fx):
    one = fx.portfolio.agg(F.count(F.lit(1)).alias("clients"), F.sum("y").alias("churned"), r(F.avg("y")).alias("rate"), r(F.sum("balance"), 2).alias("balance"))
    return one, sinks.sink_summary(one, _path(fx, "summary"))


@query("scan_json", SUMMARY_SQL)
def scan_json(fx):
    """The summary document with its declared schema."""
    one, path = _summary(fx)
    return tables.scan_json(fx.spark, path, schema=one.schema)


@query("sink_summary", SUMMARY_SQL)
def sink_summary(fx):
    """Exactly one JSON record, one per line."""
    _, path = _summary(fx)
    return tables.scan_json(fx.spark, path, schema=StructType.fromDDL("clients long, churned long, rate double, balance double"), multiline=False)


@query("sink_model", """
WITH b AS (SELECT min(granted) AS lo, max(granted) AS hi FROM portfolio_base)
SELECT client_id, round((granted - lo) / (hi - lo), 6) AS scaled FROM portfolio_active, b""")
def sink_model(fx):
    """A pipeline fitted on the labelled clients, stored, loaded and applied to the active ones."""
    steps = [VectorAssembler(inputCols=["granted"], outputCol="v"), MinMaxScaler(inputCol="v", outputCol="scaled_v")]
    path = sinks.sink_model(Pipeline(stages=steps).fit(fx.portfolio_base), _path(fx, "model"))
    return sinks.load_model(path).transform(fx.portfolio_active).select("client_id", r(vector_to_array("scaled_v")[0]).alias("scaled"))


@query("sink_bundle", """
WITH n AS (SELECT 'active' AS name, count(*) AS rows FROM portfolio_active UNION ALL SELECT 'base', count(*) FROM portfolio_base
           UNION ALL SELECT 'products', count(DISTINCT product) FROM portfolio)
SELECT name, rows, rows AS rows_found, true AS intact FROM n""")
def sink_bundle(fx):
    """Several tables as one delivery, verified against its stored manifest."""
    base = _path(fx, "bundle")
    sinks.sink_bundle(fx.spark, {"base": fx.portfolio_base, "active": fx.portfolio_active, "products": fx.portfolio.groupBy("product").count()}, base)
    return sinks.verify_bundle(fx.spark, base)


@query("schema_diff", """
SELECT * FROM (VALUES ('status', 'base', 'string'), ('y', 'base', 'int'), ('score', 'active', 'double')) AS t("column", only_in, "type")""")
def schema_diff(fx):
    """Columns of two stored tables, from their files' schemas."""
    base = sinks.sink_table(fx.portfolio_base, _path(fx, "base"))
    active = sinks.sink_table(fx.portfolio_active.drop("status", "y").withColumn("score", F.lit(None).cast("double")), _path(fx, "active"))
    return R.schema_diff(tables.scan_stage(fx.spark, base), tables.scan_stage(fx.spark, active), "base", "active")
