"""Connected components of a link table by joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, label) of every node in ``links`` (a long, b long): label is the component's least node.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so that the distance to the least node at least
    halves along stars and chains of labels. Rounds end when no label changes.
    ``parts`` is for :func:`materialize`.
    """
    both = materialize(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct(), parts)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), parts)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = materialize(step, parts)
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old")
        moved = materialize(moved, parts)
        done = moved.filter(F.col("label") != F.col("old")).limit(1).count() == 0
        discard(labels, step)
        labels = moved
        if done:
            discard(both)
            return labels
