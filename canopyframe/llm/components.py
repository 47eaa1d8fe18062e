"""Connected components of a link table, by minimum labels and pointer jumping.

Every round is made of grouped minima and equi-joins, so a node with very many
links is pre-aggregated before it is shuffled and no neighbourhood is ever
collected.  Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import checkpoint


def _settle(labels: DataFrame) -> DataFrame:
    """Follow labels until every label is its own label."""
    while True:
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = checkpoint(labels.join(parents, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a long, b long) to (node, label): label is the smallest node reachable.

    Labels always form stars: a label is its own label.  Each round the links
    are folded to links between labels, every label that has a smaller one
    among its links goes below the smallest of these, and labels are followed
    until they form stars again.  Every label but the smallest of its
    component and local minima vanishes in a round.
    """
    live = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    nodes = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        lower = live.groupBy("hi").agg(F.min("lo").alias("lower")).withColumnRenamed("hi", "node")
        labels = _settle(checkpoint(labels.join(lower, "node", "left").select("node", F.coalesce("lower", "label").alias("label"))))
        x = labels.select(F.col("node").alias("hi"), F.col("label").alias("x"))
        y = labels.select(F.col("node").alias("lo"), F.col("label").alias("y"))
        folded = live.join(x, "hi").join(y, "lo").where("x <> y")
        live = checkpoint(folded.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
