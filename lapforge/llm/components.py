"""Connected components of a link table, in rounds of joins; nothing passes through the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.tables import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Alternates large-star and small-star rounds until every link leads to a root, which takes a number of rounds
    logarithmic in the longest chain. A node with many links only sends rows, it is never gathered:
    minima are aggregated before the join. Self-links and repeated links change nothing; links with a
    null end are ignored; an empty table gives an empty one.
    """
    def open_nodes(edges):
        """Whether some node has two roots, or a root that has one itself."""
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
            edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where(
            "up > 1 or up = 1 and root = 1").limit(1).count() > 0

    edges = cut_lineage(links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while open_nodes(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of a node go to the smallest node around it
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        to = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = to.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            to.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
