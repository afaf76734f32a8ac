"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.lineage import cut, drop
from proofloom.operators.skew import join_keyed


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns ``a``, ``b``); root is the component's smallest node.

    Large-star and small-star steps alternate until every component is a star around its smallest node, which takes a
    number of rounds that grows with the logarithm of the longest path; edges that are stars already take none. Each
    step is a pre-aggregated minimum per node and a join that treats nodes with very many edges apart; no node's
    neighbours are ever gathered in one task. Every round's edges are written to the shared folder and the former
    ones deleted. Null ends and loops are ignored; an empty table gives an empty result.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_least(both))
        big = cut(join_keyed(both, large, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct())
        small = cut(_least(big))
        new = cut(
            join_keyed(big, small, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()
        )
        for x in (e, large, big, small):
            drop(x)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _are_stars(e: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v), v the smaller, has one smaller neighbour or only larger ones."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()
