"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored_at
from .keyed import split_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with an edge to another one.

    Each round points neighbours at their smallest common neighbour, so that paths shorten by a constant
    factor; a round is written to the shared folder, so lost executors never repeat earlier ones. Smallest
    neighbours are partial minima, and a node with many edges gets its own by broadcast (see split_join). Only two
    numbers per round (edge count and a hash sum) come to the driver. Loops and null ends are left out. Raises
    where most_rounds do not settle it, which some 2^30 nodes in a chain would need.
    """
    spark = edges.sparkSession
    e, path = stored_at(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        total = 2 * mark[0]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("times"))
        # the smallest of a node's neighbours and itself, met by its larger neighbours
        large = split_join(both, least, "u", "times", total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        held, large_path = stored_at(large, "edges")
        lower = held.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
        small = split_join(held, lower, "u", "times", total)
        new, new_path = stored_at(
            small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges"
        )
        old, mark = mark, _mark(new)
        discard(spark, path)
        discard(spark, large_path)
        e, path = new, new_path
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
