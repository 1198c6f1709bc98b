"""Connected components by alternating large-star and small-star rounds; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (u, v), with root the smallest node that is reachable. Nodes are longs.

    Neighbours are never gathered: a round takes the least neighbour of each node by an aggregate and joins it back, so a node of
    any degree is summed before the shuffle. The aggregate is a table of its own, so that the join reads two plain exchanges and
    adaptive execution can split the edges of a node that has very many.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "edges")
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
