"""Connected components as DataFrame rounds, for graphs too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

#: A label that many nodes carry is looked up in so many places.
SALTS = 64


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node, label)`` and undirected ``edges(a, b)`` to ``(node, label)``.

    Every node gets the smallest label reachable.  Each round takes the least
    label among a node's neighbours and then, as the labels of nodes that have
    neighbours are themselves nodes' labels, the label its label's owner has
    by now, so long chains need about the logarithm of their length in rounds.
    Labels must be unique to nodes.  Nodes without edges keep their labels.
    Rounds write to the shared folder; nothing but one count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stored(both)
    linked = both.select(F.col("a").alias("node")).distinct()
    state = stored(nodes.join(linked, "node", "left_semi").select("node", F.col("label").alias("own"), "label"))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = state.join(near, "node").select("node", "own", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = stored(step)
        discard(state)
        changed = step.where("label != was").limit(1).count()
        if not changed:
            discard(both)
            break
        # the labels in use are few; where a label's owner has itself moved on, follow it
        owners = step.select(F.col("own").alias("label"), F.col("label").alias("next")).where("label != next")
        owners = owners.join(step.select("label").distinct(), "label", "left_semi")
        wide = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = step.select("node", "own", "label", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
        state = stored(salted.join(wide, ["label", "salt"], "left").select("node", "own", F.coalesce("next", "label").alias("label")))
        discard(step)
    done = step.select("node", F.col("label").alias("found"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("found", "label").alias("label"))
