"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of the edges ``a``, ``b`` (long).

    Alternates two kinds of rounds until nothing changes: each node hands its
    smallest neighbour to the larger ones, then to the smaller ones and itself.
    The table stays within twice the edges; each round's result is checkpointed.
    Minima are counted up before they are dealt out and joined back, so that a node
    of very many edges is no task of its own.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    before = None

    def with_least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", F.least("a", "m").alias("m"))

    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
        before = state
        both = edges.union(edges.select("b", "a"))
        large = with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        edges = cut_lineage(small.filter("a <> b").distinct())
