"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _signature(edges: DataFrame):
    """Count and order-free checksum of an edge set."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of an undirected edge table.

    Alternating large-star and small-star rounds (every node's larger neighbours, then the node itself
    and its smaller neighbours, are hooked to the smallest one) until the edges no longer change: a
    logarithmic number of rounds in practice whatever the diameter, without a cap. A round joins the
    edges with one minimum per node, so the neighbours of a hub are never gathered. Each round is
    checkpointed. Rows with a null end are ignored; self loops give a component of one node.
    """
    raw = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    nodes = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cur = materialize(raw.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _signature(cur)
    while before[0]:
        d = _directed(cur)
        low = d.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = d.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b") \
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # small star: edges point from the larger end (b) to its smaller neighbours (a)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("b"), F.col("m").alias("a")) \
            .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        cur = materialize(small)
        after = _signature(cur)
        if after == before:
            break
        before = after
    return nodes.join(cur.groupBy("b").agg(F.min("a").alias("m")), nodes["node"] == F.col("b"), "left") \
        .select("node", F.coalesce("m", "node").alias("component"))
