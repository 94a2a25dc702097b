"""Connected components of a large graph, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: long); a component is named by its smallest node.

    Each round gives a node the least label around it and then its label's label, until no label changes; labels are
    written to the shared folder after each round. Minima are taken by partial aggregation, so a node with very many
    links costs a task one row."""
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        moved = labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("now"))
        jump = moved.select(F.col("node").alias("now"), F.col("now").alias("next"))
        new = moved.join(jump, "now").select("node", "was", F.least("now", "next").alias("component"))
        new = stored(new, "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
