"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    """a, m: the least b of each a, from partial minima."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """a, b, m: every edge with the least node of its a.

    Edges are two numbers, so a hub's edges are small; where they exceed a
    partition's size all the same, adaptive execution splits them (skew join),
    as nothing above the join asks for its partitioning.
    """
    return edges.join(least, "a").select("a", "b", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("m", "a").alias("m"))
    return _beside(both.filter(F.col("b") > F.col("a")), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these; edges point from a down to b."""
    least = _least(edges)
    moved = _beside(edges, least).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), the component being its least node.

    Each round is written to the shared folder, so neither the plan nor a lost
    executor's work grows with the rounds; nothing is collected but a checksum.
    """
    down = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, mark = written(down.distinct(), "edges"), None
    for _ in range(most):
        new = written(_small(_large(edges).distinct()).distinct(), "edges")
        seen = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        drop_written(edges)
        edges = new
        if mark == (seen["n"], seen["x"]):
            break
        mark = (seen["n"], seen["x"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
