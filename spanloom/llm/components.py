"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every
round is a grouped minimum and a join, both of which spread a hot vertex: the
minimum is pre-aggregated in each task, and a join is split where a key is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex has one parent and no parent is a child."""
    many = edges.groupBy("u").count().filter("count > 1").limit(1)
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").limit(1)
    return not many.count() and not chained.count()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` for every vertex of the edges ``u, v`` (longs).

    ``component`` is the smallest vertex that can be reached.  Direction, loops,
    repeated edges and edges with a null end don't matter; a vertex that only has
    loops or null partners isn't returned, nor is anything for no edges.  A round
    is written to the scratch folder; the loop ends with a forest of stars.
    """
    kept = edges.filter("u is not null and v is not null and u <> v")
    now = scratch.table(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(now):
        now = scratch.table(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
