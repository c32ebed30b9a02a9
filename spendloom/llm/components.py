"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b): label is the least node of the component.

    Every round takes the least label among a node and its neighbours and then the label of that label, so
    a star is done in two rounds and a path of n nodes in about log n. Labels are checkpointed each round.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("found"))
        offered = both.join(known, "other").groupBy("node").agg(F.min("found").alias("found"))
        nearer = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "found").alias("label"))
        nearer = checkpointed(nearer)
        jumped = nearer.join(nearer.select(F.col("node").alias("at"), F.col("label").alias("further")), F.col("label") == F.col("at"))
        new = checkpointed(jumped.select("node", "old", F.least("label", "further").alias("label")))
        changed = new.filter("label != old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
