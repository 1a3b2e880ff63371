"""Sinks (S5-S9). Writes are distributed; nothing is collected to build a file."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import fingerprint


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None) -> str:
    """Write a result table (parquet by default, CSV with header on request)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def sink_summary(df_one_row: DataFrame, path: str) -> str:
    """Scalar metrics as one JSON record; any other number of rows is an error."""
    if df_one_row.limit(2).count() != 1:
        raise ValueError("a summary is exactly one row")
    df_one_row.coalesce(1).write.mode("overwrite").json(path)
    return path


def sink_model(model: PipelineModel, path: str) -> str:
    """Save a fitted pipeline (model + calibrator stages)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _read_back(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).option("header", True).load(path)


def sink_bundle(spark: SparkSession, tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> DataFrame:
    """Many named result tables as one delivery: one folder each plus a manifest table
    (name, path, format, rows, checksum). Rows and fingerprint are those of the written files, one distributed
    pass a table. An older manifest goes before its tables are touched (an empty one replaces it) and the new
    one is published last, so a delivery that stopped half-way does not verify."""
    base = base.rstrip("/")
    schema = "name string, path string, format string, rows long, checksum string"
    sink_table(spark.createDataFrame([], schema), f"{base}/_manifest", fmt="parquet")
    rows = []
    for name, df in tables.items():
        path = f"{base}/{name}"
        sink_table(df, path, fmt=fmt)
        mark = fingerprint(_read_back(spark, path, fmt)).first()
        rows.append((name, path, fmt, mark["rows"], mark["checksum"]))
    manifest = spark.createDataFrame(rows, schema)
    sink_table(manifest, f"{base}/_manifest", fmt="parquet")
    return manifest


def verify_bundle(spark: SparkSession, base: str) -> DataFrame:
    """Each table of a delivery against its manifest: (name, rows, rows_found, intact). A manifest without
    tables (a delivery that never ended) is an error; a table that cannot be read is not intact."""
    manifest = spark.read.parquet(f"{base.rstrip('/')}/_manifest").collect()     # one row a table of the delivery
    if not manifest:
        raise ValueError(f"the delivery at {base} was not finished")
    out = []
    for m in manifest:
        try:
            mark = fingerprint(_read_back(spark, m["path"], m["format"])).first()
        except AnalysisException:     # folder missing or without any file
            out.append((m["name"], m["rows"], None, False))
            continue
        out.append((m["name"], m["rows"], mark["rows"], mark["rows"] == m["rows"] and mark["checksum"] == m["checksum"]))
    return spark.createDataFrame(out, "name string, rows long, rows_found long, intact boolean")


def nested_payload(blocks: dict[str, DataFrame], max_rows: int = 10_000) -> DataFrame:
    """One nested document from several small result blocks.

    Each block becomes one list, in the order of its columns; a block of more than ``max_rows`` rows is
    refused (one document is one row, built in one task). NaN / infinite values are refused like a strict
    JSON writer would (``allow_nan=False``)."""
    parts = None
    for name, df in blocks.items():
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"block {name} has more than {max_rows} rows")
        dbl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        checked = df
        for c in dbl:
            checked = checked.withColumn(
                c, F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(math.inf)),
                          F.raise_error(F.lit(f"non-finite value in {name}.{c}"))).otherwise(F.col(c)))
        one = checked.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        parts = one if parts is None else parts.crossJoin(one)
    return parts.select(F.to_json(F.struct(*blocks.keys())).alias("payload"))
