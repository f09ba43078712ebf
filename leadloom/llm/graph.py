"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the least node that it reaches.

    Each round takes the least label among a node and its neighbours and then the label
    of that label, so chains shrink fast. Rounds are written to the shared folder; a hot
    node's links are combined map-side, and joins read plain tables that Spark can split.
    """
    edges = durable(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = durable(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = durable(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = durable(least.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), "old"), "labels")
        if after.filter("label < old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
