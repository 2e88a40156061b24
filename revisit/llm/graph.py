"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.shared import keep


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours to the least of them. ``larger``: only neighbours
    above the node move; else the node and those below it."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))  # u > v in every edge
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is the
    smallest node reachable. Alternating star contractions: each round is aggregates
    and joins over the edges, written to the shared folder; a hub's edges are
    pre-aggregated and its join side can be split. The number of rounds grows with
    the logarithm of the nodes."""
    now = keep(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.expr("coalesce(sum(xxhash64(u, v) % 1000000007), 0)")).first()
    state = mark(now)
    while True:
        now = keep(_stars(_stars(now, True), False), name)
        new = mark(now)
        if tuple(new) == tuple(state):
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
