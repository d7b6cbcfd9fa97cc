"""Connected components of an edge table, in Spark rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.session import materialize_measured


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node (the larger ones, or the smaller) to its smallest."""
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    around = back.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else back
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that an edge (``a``, ``b``) touches; root is the least node.

    The edges of a round are stored in the shared folder; the driver sees their count and
    a checksum only. The number of rounds grows with the logarithm of the nodes.
    """
    mark = {"n": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, seen = materialize_measured(ordered.filter("a <> b").distinct(), "edges", **mark)
    while seen["n"]:
        edges, now = materialize_measured(_stars(_stars(edges, True), False), "edges", **mark)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
