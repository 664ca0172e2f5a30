"""Connected components by alternating stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tessera.scratch import cut, drop


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges in the shared folder, and their number and checksums, gathered by the same job."""
    mark = Observation()
    code = F.xxhash64("a", "b")
    seen = edges.observe(mark, F.count(F.lit(1)).alias("n"), F.bit_xor(code).alias("x"), F.sum(code.cast("decimal(20,0)")).alias("s"))
    return cut(seen, "edges", compact=True), mark.get


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each round is a
    partially aggregated minimum per node and a join on the node, so a hub's
    edges are never gathered into one row; AQE may split the hub's join. Rounds
    end when a whole round leaves the edges as they were. Nulls and self-links
    are ignored; an empty table gives an empty result.
    """
    now, before = _written(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a > b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        own, other = F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(small_min, "a").select(F.explode(F.array(own, other)).alias("e")).select("e.*")
        after, mark = _written(small.where("a > b").distinct())
        drop(now)
        now = after
        if mark == before:
            break
        before = mark
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
