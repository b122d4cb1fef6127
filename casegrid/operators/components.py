"""Connected components by alternating star contraction (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casegrid.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour.

    The links may repeat and all point from the larger to the smaller node.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
        edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(smallest, "u")
        .select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src <> dst")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(smallest, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return (
        linked.unionByName(smallest.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        .where("src <> dst").distinct()
    )


def _is_settled(links: DataFrame) -> bool:
    """Is every node either a centre or linked to exactly one centre?"""
    one, none = F.lit(1), F.lit(0)
    ends = links.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), one.alias("up"), none.alias("down")),
                F.struct(F.col("dst").alias("node"), none.alias("up"), one.alias("down")),
            )
        )
    )
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return degrees.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(src, dst)``; the component is its smallest node.

    Node ids are any orderable type. The number of rounds grows with the logarithm of the longest
    chain. Each round is written to the checkpoint folder; only a yes or no reaches the driver.
    """
    links = cut_lineage(edges.select("src", "dst").distinct(), few=True)
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    links = links.where("src <> dst")
    settled = False
    while not settled:
        links = cut_lineage(_small_star(_large_star(links)), few=True)
        settled = _is_settled(links)
    labels = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
