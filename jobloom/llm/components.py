"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import cut_lineage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of the links: the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so long chains fold up in logarithmically many rounds. Rounds are cut by checkpoints.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = cut_lineage(edges.union(edges.select("other", "node")).filter("node <> other").distinct())
    labels = cut_lineage(edges.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
    while True:
        seen = edges.join(labels.select(F.col("node").alias("other"), "label"), "other")
        near = seen.groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("far"))
        following = cut_lineage(
            lower.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.col("label") > F.least("new", F.coalesce("far", "new"))).alias("moved"))
        )
        if not following.filter("moved").limit(1).count():
            return following.select("node", "label")
        labels = following.select("node", "label")
