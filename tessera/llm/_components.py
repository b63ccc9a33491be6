"""Connected components of an edge table by alternating large and small stars; nothing gathers on the driver.

Least neighbours are written before they are joined, so that both sides of the join are plain scans and adaptive
execution can split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import written


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both)
    return written(both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of these. Edges run from the larger node to the smaller."""
    told = edges.join(_least(edges), "u")
    out = told.select("u", F.col("m").alias("v")).unionByName(told.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return written(out.distinct(), "small")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge out at most, and none if it has edges in: then v is u's component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0").isEmpty()


def components(edges: DataFrame, plain: bool = False) -> DataFrame:
    """edges: u, v. Rows (u, v): each node that isn't its component's least, and that least node.

    plain: edges are rows of written tables with u > v, few of them twice, and needn't be written again.
    """
    edges = edges if plain else written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        edges = _small(_large(edges))
    return edges
