"""Connected components of a link table: minimum labels with pointer jumping, a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of links (a, b); a component is named by its smallest vertex.

    Each round takes the smallest label of all neighbours (folded before the shuffle, so that a vertex
    with very many links is spread) and then the label of the label, which halves the way to go.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"),
        "links",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).select("v", F.least("v", "c").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both["a"] == labels["v"])
            .groupBy("b")
            .agg(F.min("component").alias("_near"))
            .withColumnRenamed("b", "v")
        )
        lower = labels.join(near, "v").select("v", "component", F.least("component", "_near").alias("_low"))
        above = labels.select(F.col("v").alias("_low"), F.col("component").alias("_jump"))
        moved = stored(
            lower.join(above, "_low", "left").select(
                "v", F.least("_low", "_jump").alias("component"), (F.least("_low", "_jump") < F.col("component")).alias("_moved")
            ),
            "labels",
        )
        labels = moved.select("v", "component")
        if not moved.where("_moved").limit(1).count():
            return labels
