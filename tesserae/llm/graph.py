"""Connected components by alternating large-star and small-star, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, looked_up, stash

ROUNDS = 60
#: Beyond so many edges a node's edges may be too many for a task, and its least neighbour is looked up by weight.
HUB_EDGES = 1_000_000


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges(u, v), u > v. Large: every node links its greater neighbours to its least; small: the lesser ones."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("m", "u"))
    if n > HUB_EDGES:
        least = stash(least, "components-least")
        joined = looked_up(near, least, "u", "degree", F.col("v"))
    else:
        joined = near.join(least.drop("degree"), "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the least node that is reachable, for every node with a link."""
    edges = stash(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    mark = _mark(edges)
    for _ in range(ROUNDS):
        starred = _stars(_stars(edges, True, mark[0]), False, mark[0])
        before, edges = starred, stash(starred, "components")
        new = _mark(edges)
        drop(before)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no stable stars after {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
