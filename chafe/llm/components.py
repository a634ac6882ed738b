"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; label = least node reachable.

    Each round does, as joins of written tables: every node takes the least
    label among its own and its neighbours' (a map-side combined min, so a hub
    never gathers its neighbours in one task), every *label* is hooked under
    the least label its members saw, and labels are replaced by their label's
    label.  Rounds grow with the logarithm of the component diameter, and
    only one count returns to the driver per round.
    """
    sym = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct())
    labels = written(sym.groupBy("a").agg(F.min("b").alias("least"))
                     .select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        seen = sym.join(labels.withColumnRenamed("node", "b"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        state = written(labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("near")))
        # hook: the old root learns the least label any of its members has seen
        hooks = written(state.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("to")))
        moved = state.join(hooks, state["label"] == hooks["root"]) \
            .select("node", F.least("near", "to").alias("via"), F.col("label").alias("was"))
        # jump: follow the pointer of the label just taken, where it has one
        jump = hooks.select(F.col("root").alias("via"), F.col("to").alias("onward"))
        nxt = written(moved.join(jump, "via", "left")
                      .select("node", F.least("via", "onward").alias("label"), "was"))
        changed = nxt.where(F.col("label") != F.col("was")).limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
