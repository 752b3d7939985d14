"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in ``links(a, b)``; label is the smallest
    node of its component.

    Each pass takes the smallest label among a node and its neighbours, then
    the label's own label (pointer jumping), so a chain of length n needs
    about log n passes. Passes end when no label changes; each is written to
    the shared folder, so a lost executor repeats one pass at most. An empty
    link table gives an empty result."""
    both = scratch.cut(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    labels = scratch.cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the label is itself a node: where it has a smaller label, take that
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = step.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")
        )
        changed = Observation()
        step = scratch.cut(step.observe(changed, F.count_if(F.col("label") != F.col("old")).alias("n")), "labels")
        scratch.delete(labels)
        labels = step
        if not changed.get["n"]:
            scratch.delete(both)
            return step.select("node", "label")
