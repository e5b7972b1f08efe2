"""Connected components of a link table, as repeated joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: link each node's greater neighbours to its least
    neighbour (or itself); small: link its lesser neighbours and itself there.
    The least neighbour comes from an aggregation that combines before the
    shuffle and joins back, so a node with very many links is no single group
    (AQE splits its side of the join)."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is
    the smallest node reachable. Alternating star steps until nothing changes:
    the number of rounds grows with the logarithm of the longest chain. Every
    round is written to the shared folder and the one before it deleted."""
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    current = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _fingerprint(current)
    while seen[0]:
        after = scratch.write(_star(_star(current, large=True), large=False))
        now = _fingerprint(after)
        scratch.drop(current)
        current = after
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
