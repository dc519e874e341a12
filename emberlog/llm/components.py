"""Connected components of a graph that no task or driver ever holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.sources.tables import land


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): the smallest node each linked node reaches.

    Alternating stars: every round hangs nodes onto the smallest neighbour of their
    neighbourhood, so paths shrink by half and copies of one text are one round.
    A round is two aggregates and two joins by hash; its edges are written.
    """
    edges = land(edges.where("a != b").distinct(), "edges")
    state = None
    while not edges.isEmpty():
        edges = land(_small_star(_large_star(edges).distinct()).where("a != b").distinct(), "stars")
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
