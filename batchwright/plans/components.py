"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step only needs the least neighbour of every node, which partial aggregation finds before the shuffle, so a node
with a third of all edges is no hot spot; these are written, so that the join back has exchanges of its own and
adaptive execution can split them. The number of rounds grows with the logarithm of the longest path, and every round is
a table in the shared folder. As long as the
edges are few enough for one task, they are put together there, without rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.session import materialize, ship_package


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _together(batches):
    """The components of few edges, by union-find."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(y, y)
        return x

    for pairs in batches:
        for a, b in zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], names=["node", "label"])


def components(edges: DataFrame, in_task: int = 200_000) -> DataFrame:
    """node, label (the least node of its component), for the nodes of ``edges`` (u, v: long). Loops, repeated edges
    and nulls are allowed and mean nothing; no edges give no rows. Up to ``in_task`` different edges (they are counted)
    are put together in one task."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    state = _state(now)
    if 0 < state[0] <= in_task:
        ship_package(now.sparkSession)
        return materialize(now.coalesce(1).mapInArrow(_together, "node long, label long"), "components")
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct(), "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
