"""Scans (S1-S4): every read declares its schema or reads parquet, whose schema is in the file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def scan_table(spark: SparkSession, base_dir: str, name: str, columns: Iterable[str] | None = None,
               schema: StructType | None = None) -> DataFrame:
    """One table of a population. Column selection is declared here so it reaches
    the parquet ``ReadSchema``; filters applied later are pushed down by Catalyst."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ";",
                   header: bool = True) -> DataFrame:
    """Delimited text with a custom separator and an explicit schema (no inference pass)."""
    return (spark.read.option("sep", sep).option("header", header)
            .option("mode", "FAILFAST").schema(schema).csv(path))


def scan_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """S3: read back a stage table written by :func:`strata.sources.sinks.sink_table`."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def scan_json(spark: SparkSession, path: str, schema: StructType | None = None, multiline: bool = True) -> DataFrame:
    """A JSON summary document (one record per file when ``multiline``)."""
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)
