"""Connected components of an edge table, distributed: alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Each round is two groupings of the edges by
vertex; rounds grow with the logarithm of the longest path. A vertex with very many neighbours is no problem for memory:
``min`` is combined before the shuffle and the join on the hot vertex is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import scratch


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every neighbour that is larger (or not) than v to the smallest of v and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(a, component)``: for every vertex that is not its component's smallest.

    Loops and repeated edges are allowed; an empty table gives an empty result. Each round's edges are a written table that
    replaces the last round's. Every round moves edges to smaller vertices or changes nothing, so the rounds end.
    """
    edges = scratch.table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), "cc")
    previous = None
    while True:
        before, edges = edges, scratch.table(_star(_star(edges, True), False), "cc")
        scratch.drop(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous or not state[0]:
            return edges.groupBy("a").agg(F.min("b").alias("component"))
        previous = state
