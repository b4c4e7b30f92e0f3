"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a BIGINT, b BIGINT): ``root`` is the smallest node that can be reached.

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest neighbour, then
    its smaller ones. Components become stars around their smallest node in about log n rounds, and the number of
    edges never grows. Every round is written out. Edges from a node to itself or with nulls are left out; an empty
    table gives an empty one.
    """
    clean = edges.where((F.col("a") != F.col("b"))).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = store(clean, "edges")
    before = _mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
        now = store(small, "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
