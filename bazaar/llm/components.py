"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.shared import store


def components(links: DataFrame) -> DataFrame:
    """``node`` and its component's ``label`` for every node of ``links`` (columns ``a``, ``b``).

    In each round every node moves to the least node next to it, and links move
    along, so parts of a component meet in ever fewer nodes until no link is left.
    Node numbers should be random, such as hashes: then the rounds grow with the
    logarithm of a component's size.  Nodes without links are not in the result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = store(both.where("a <> b").distinct(), "component-edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while not edges.isEmpty():
        least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        step = store(least, "component-steps")
        moved = (
            edges.join(step, "a").select(F.col("least").alias("u"), F.col("b").alias("a"))
            .join(step, "a").select(F.col("u").alias("a"), F.col("least").alias("b"))
        )
        labels = store(
            labels.join(step.withColumnRenamed("a", "label"), "label", "left").select(
                "node", F.coalesce("least", "label").alias("label")
            ),
            "component-labels",
        )
        edges = store(moved.where("a <> b").distinct(), "component-edges")
    return labels
