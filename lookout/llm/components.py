"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lookout.llm.common import discard, stored
from lookout.operators.joins import lookup


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; component: the least node.

    A step groups by node with a minimum, which combines before the shuffle, and joins
    that minimum back, which splits hot nodes; no neighbour list is ever held. Each round
    is a written table, so the lineage stays short and a lost executor costs one round.
    """
    stars = stored(_down(edges), "components")
    seen = _digest(stars)
    while True:
        before, stars = stars, stored(_small(_large(stars)), "components")
        discard(before)
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _down(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u != v")
        .distinct()
    )


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
    least = both.groupBy("x").agg(F.min("y").alias("m"))
    least = least.select("x", F.least("x", "m").alias("m"))
    return (
        lookup(both, least, ["x"], "inner")
        .where("y > x")
        .select(F.col("y").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = lookup(e, least, ["u"], "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
