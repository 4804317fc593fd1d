"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges, so a vertex of any
degree is spread by the join's skew handling and nothing is gathered per
vertex.  The edges of a component shrink to a star around its least vertex in
a logarithmic number of rounds; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.shared import materialise


def _toward_min(pairs: DataFrame) -> DataFrame:
    """pairs (a, b): for each a, m = least of a and its b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return pairs.join(least, pairs.a == least.k).select("a", "b", "m")


def star_edges(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(id, component): each vertex that is not the least of its component, with the least one.

    edges: undirected, each given in either direction; loops and repeats are ignored.
    """
    current = materialise(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct())
    known = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_min(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _toward_min(large)
        current = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
        known = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(vertices: DataFrame, edges: DataFrame, id_col: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the least vertex of each vertex's component."""
    stars = star_edges(edges, src, dst).select(F.col("id").alias("k"), "component")
    joined = vertices.select(F.col(id_col).alias("id")).join(stars, F.col("id") == F.col("k"), "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))
