"""Connected components by smallest labels with pointer jumping, as joins and
aggregates; the driver sees one count per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node
    reachable.  Edges of a hub are narrow rows on plain exchanges, which
    adaptive execution may split; the smallest label of a node is
    pre-aggregated before the shuffle."""
    both = materialize(edges.select("a", "b").filter("a <> b").distinct())
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"])
                .groupBy(F.col("a").alias("n")).agg(F.min("component").alias("near")))
        lower = labels.join(near, labels["node"] == near["n"]).select(
            "node", "component", F.least("component", "near").alias("low"))
        far = labels.select(F.col("node").alias("n"), F.col("component").alias("jump"))
        # the label of the label, which is at least as low
        step = materialize(lower.join(far, lower["low"] == far["n"], "left").select(
            "node", F.least("low", F.coalesce("jump", "low")).alias("component"),
            (F.least("low", F.coalesce("jump", "low")) < F.col("component")).alias("changed")))
        labels = step.select("node", "component")
        if step.filter("changed").isEmpty():
            return labels
