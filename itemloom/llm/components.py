"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every step is a grouped minimum (combined before its shuffle) and an equi-join (whose skew adaptive execution splits), so
a node with very many neighbours costs no task more than others. Rounds end when the edges no longer change; their number
grows with the square of the nodes' logarithm at most. Each round is written to the shared folder, which ends its lineage;
nothing but a row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, distinct. Links neighbours to the least one: the larger neighbours (large), or the smaller ones and the node."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m") if large else "m")
    joined = near.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each node that an edge touches, the least node of its component (the label's own row included).

    edges: columns a and b, of one type with an order; direction, repeats and loops don't matter; rows with nulls are dropped; a table without edges gives no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, after = None, _digest(edges)
    while after[0] and after != before:
        edges = materialize(_star(_star(edges, True), False), drop=edges)
        before, after = after, _digest(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
