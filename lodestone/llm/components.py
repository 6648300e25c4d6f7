"""Connected components of a graph that may be larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged

#: Rounds double what a label reaches, so that this many suffice for any graph.
ROUNDS = 60


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each node that
    has an edge and is not itself the smallest.

    ``edges`` has the columns u and v (longs); loops, repeats and either
    direction are fine. Alternating large and small stars: every node's larger
    neighbours, then its smaller ones, are hung below the smallest neighbour,
    until nothing moves. All steps are grouped minima and joins on them, whose
    hot nodes Spark pre-aggregates and splits; each round is written out.
    """
    edges = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v")
        large = staged(large.distinct(), "large-star")
        small = large.join(_minima(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        edges = staged(small.filter("u != v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == print_of:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        print_of = now
    raise RuntimeError(f"labels still move after {ROUNDS} rounds")
