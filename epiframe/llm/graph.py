"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of ``edges`` (a, b) with the least vertex of its component.

    Each round takes the least label among a vertex and its neighbours and then
    follows labels one step (so chains halve); it stops when nothing changes. The
    state is written to the shared folder after every round.
    """
    both = materialise(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "cc")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        least = labels.join(near, "v", "left").select("v", "c", F.least("c", "m").alias("n"))
        up = labels.select(F.col("v").alias("n"), F.col("c").alias("up"))
        new = materialise(least.join(up, "n", "left").select("v", "c", F.least("n", "up").alias("n")), "cc")
        changed = new.where("n <> c").limit(1).count()
        labels = new.select("v", F.col("n").alias("c"))
        if not changed:
            return labels
