"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._store import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Each step takes a minimum per node (combined before the shuffle) and an equi-join, so that a node with very many
    neighbours is never gathered in one place. Nulls and loops are ignored; an empty table gives an empty result.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, name)
    mark = _mark(e)
    while mark[0]:
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, are linked to the smallest.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        out = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = materialize(out.distinct(), name)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
