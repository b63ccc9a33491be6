"""Join patterns: parents with children, the latest children of each parent, rows by a list of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .query import Sort, order_of


def parent_children(parents: DataFrame, children: DataFrame, parent_key: str, foreign_key: str, how: str = "inner") -> DataFrame:
    """Spark picks broadcast or shuffle by the sides' sizes."""
    return parents.join(children, parents[parent_key] == children[foreign_key], how)


def latest_per_parent(children: DataFrame, foreign_key: str, by: str, n: int, key: str = "_id") -> DataFrame:
    """The n latest children of every parent, in one job. rank <= n lets Spark prune before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(foreign_key).orderBy(*order_of(children, [Sort.desc(by)], key))
    return children.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (a frame, of any size)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
