"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tables of ids with up to this many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the least node of its component.

    Each round takes the least label among the neighbours and then that label's own label, until nothing
    changes. Labels are written to the shared folder after each round, so a lost executor costs one round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rows = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        of = hinted(labels, rows)
        near = both.join(of.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        low = near.join(of, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("low"))
        jump = of.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        step = low.join(jump, "low", "left").select("node", F.least(F.coalesce("lower", "low"), "low").alias("label"), "old")
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label != old").isEmpty():
            return labels
