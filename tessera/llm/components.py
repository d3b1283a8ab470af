"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut, merged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest node of the node's neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return merged(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = merged(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.max(F.hash("v", "u"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    ``edges`` has two columns of one orderable type. Loops, repeated edges and either direction are allowed; rows with
    a null end are ignored; no edges give no rows. Joins and pre-aggregated minima only: the neighbours of a hub are
    never gathered. Each round is checkpointed. Only three numbers a round come to the driver.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _state(stars)
    for _ in range(rounds):
        stars = cut(_small_star(_large_star(stars)))
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(stars.select("v", "v").distinct())
