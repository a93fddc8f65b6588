"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.storage import small_or_not, stored


def _beside_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u.

    The minima are written first: the join then reads two tables, of which the minima are broadcast if
    few; else both are shuffled, so that the adaptive skew join can split a node of very many edges.
    """
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(small_or_not(least), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _beside_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _beside_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Rounds go on until nothing changes, which they always reach: every step lowers a neighbour or leaves all as
    it was.  Every round is written to the shared folder; only a count and a checksum come to the driver.

    Defined cases: self-loops and edges with a null end are ignored, so a node of none but those isn't in
    the result; repeated edges count once.  Extra columns are ignored.  An empty table gives an empty result.
    """
    edges = stored(edges.where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        large = stored(_large_star(edges).distinct(), "edges")
        edges = stored(_small_star(large).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
