"""Connected components of a distributed edge list by alternating large-star and small-star.

Every round is two aggregations with map-side combining and two joins, so a hub with a
third of all edges is combined before it is shuffled. Each round's edges and lowest
neighbours are written to the shared folder, so both sides of a join are plain shuffles and
a hub's partition can be split at run time. Nothing is collected but
a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges between longs to (node, root): root is the smallest node reachable, for nodes that aren't their own root.

    Self-loops, repeated edges and empty input are fine (null ends are dropped).
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first_low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.where(F.col("v") > F.col("u")).join(first_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(edges, large, first_low, low)
        edges = after
        was, state = state, _state(edges)
        if was == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
