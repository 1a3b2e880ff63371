"""Components of a link table by local contraction.

In a round every node goes over to the least one among itself and its neighbours, by a keyed hash; links are
renamed after it, and links inside a node vanish. A local maximum always goes, so nodes shrink by a constant
factor in a pair of rounds whatever the shape of the graph. Each round's map is kept; at the end the maps
are composed from the last (smallest) to the first. A hub's neighbours are only aggregated, never gathered.
Once at most ``FINISH`` links are left, a counted bound, one task joins them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Links that one task may finish; more are contracted first.
FINISH = 50_000


def _roots(batches):
    """(node, to) of all nodes of at most ``FINISH`` links: to is the least node of the component."""
    above: dict[int, int] = {}

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(above.setdefault(a, a)), root(above.setdefault(b, b))
            above[max(a, b)] = min(a, b)
    nodes = np.array(list(above), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([root(x) for x in nodes.tolist()], pa.int64())], names=["node", "to"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of ``links`` (a, b): component is the smallest node that can be reached."""
    left = materialize(links.select("a", "b").filter("a <> b").distinct())
    maps, turn = [], 0
    while n := left.count():
        if n <= FINISH:
            maps.append(materialize(left.coalesce(1).mapInArrow(_roots, "node long, to long")))
            break
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # first by the nodes themselves (stars around a least node take one round), then by hashes, each for two rounds
        h = lambda c: F.lit(0) if turn < 2 else F.xxhash64(F.lit(turn // 2), c)  # noqa: B023, E731
        rank = lambda c: F.struct(h(c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        maps.append(materialize(least.select(F.col("u").alias("node"), F.least("m", rank("u"))["to"].alias("to"))))
        a, b = (maps[-1].select(F.col("node").alias(c), F.col("to").alias(f"new_{c}")) for c in "ab")
        left = materialize(left.join(a, "a").join(b, "b").filter("new_a <> new_b")
                           .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
        turn += 1
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps.pop()
    while maps:
        later = found.select(F.col("node").alias("at"), F.col("to").alias("end"))
        step = maps.pop()
        found = step.join(later, F.col("to") == F.col("at"), "left").select("node", F.coalesce("end", "to").alias("to"))
    found = materialize(found)
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
