"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node that each node is connected with.

    Nodes hand the smallest label among their neighbours and themselves to the node that holds their label, and then
    take the label of their label, so that rounds grow with the logarithm of the longest chain. Every round is an
    aggregate and a join, cut to the checkpoint folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(edges.select(b, a)).distinct().checkpoint()
    label = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")).select(F.col("x").alias("node"), "to").checkpoint()
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("to").alias("near")), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        seen = label.join(near, "node").select("node", "to", F.least("to", "near").alias("low"))
        # the holder of a label learns the smallest label that any of its followers has seen
        hooked = seen.groupBy("to").agg(F.min("low").alias("held"))
        lower = seen.join(hooked, "to").select("node", F.col("to").alias("old"), F.least("low", "held").alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = lower.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("next", "low")).alias("to")).checkpoint()
        if new.where("old <> to").isEmpty():
            return new.select("node", F.col("to").alias("component"))
        label = new.select("node", "to")
