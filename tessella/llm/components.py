"""Connected components of a graph of links, with joins only: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


def components(links: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable. ``like``: a written table of about as many rows.

    Each round takes the smallest label among neighbours and then the label of that label, so that labels
    cross a component of diameter d in about log d rounds.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", like)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels", both)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("further"))
        moved = cut(nearer.join(jump, "next", "left").select("id", "old", F.least("next", F.coalesce("further", "next")).alias("component")), "labels", both)
        labels = moved.select("id", "component")
        if moved.where("old <> component").limit(1).count() == 0:
            return labels
