"""Shared helpers of the text operators: the word definition, checked broadcasts, staged
tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize

#: ASCII white space, as a Java / RE2 character class body; a word is a run of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Largest row count that is broadcast on purpose. Beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table with a broadcast hint if its counted size allows it; a larger one
    comes back without the hint, for a shuffle join that AQE may split."""
    df = materialize(df)
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it again: cuts the lineage in
    compressed columnar files that any executor can read after another one is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/strata-llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Empty the files of staged tables that are no longer read."""
    for df in frames:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Ask the driver JVM for a collection, so that the context cleaner deletes shuffle files of
    finished phases before the next phase writes its own."""
    spark.sparkContext._jvm.System.gc()


def every(df: DataFrame, *but: str) -> list[Column]:
    """All columns of a frame by their exact names."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


def names(prefix: str, taken: list[str], *wanted: str) -> list[str]:
    """Column names for internal use that clash with none of the frame's own."""
    have = {c.lower() for c in taken}
    out = []
    for w in wanted:
        n = f"{prefix}{w}"
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out
