"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node.

    Each round gives every node the smallest label among itself and its neighbours, then the
    label of that label, so chains halve; it ends when no label changes. Labels are stored
    after each round. Minima combine before the shuffle, and the joins are plain ones whose
    hot sides adaptive execution splits, so a node with very many links is no problem.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store(both.where("a <> b").distinct(), "links")
    labels = store(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels"
    )
    while True:
        other = labels.select(F.col("node").alias("a"), F.col("component").alias("seen"))
        reached = both.join(other, "a").groupBy(F.col("b").alias("node")).agg(F.min("seen").alias("seen"))
        near = labels.join(reached, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("near")
        )
        target = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = store(
            near.join(target, "near", "left").select(
                "node", F.coalesce(F.least("far", "near"), "near").alias("component"), "old"
            ),
            "labels",
        )
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
