"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for the nodes of edges ``a``, ``b``.

    Alternates two star operations: every node hands its larger neighbours to
    the smallest node it sees, then its smaller ones. Each step is a partial
    aggregate and an equi-join, so a node with very many neighbours is split by
    adaptive execution. Edges are written between rounds; the number of rounds
    grows with the logarithm of the largest component.
    """
    edges = written(_oriented(edges), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        new = _state(edges)
        if new == state:
            break
        state = new
    own = edges.groupBy(F.col("lo").alias("node")).agg(F.min("lo").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(own)


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("hi", "m")))
