"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import forget, save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in `edges`: component is the smallest id reachable.

    Each round takes the smallest label among a node's neighbours, hooks it on the node's own label as well, and
    follows labels one step further, so that long chains halve. Rows with a null end and self-links name their ids
    only. Every round is written to the shared folder; the loop ends when no label changes.
    """
    flat = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = save(flat.union(flat.select("b", "a")).filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    while True:
        ends = both.join(labels.select(F.col("id").alias("b"), F.col("c").alias("low")), "b")
        near = ends.groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"))
        seen = labels.join(near, "id")
        offers = seen.select("id", "low").union(seen.select(F.col("c").alias("id"), "low"))
        best = offers.groupBy("id").agg(F.min("low").alias("low"))
        hooked = labels.join(best, "id", "left").select(
            "id", F.col("c").alias("was"), F.least("c", F.coalesce("low", "c")).alias("c")
        )
        hooked = save(hooked, "hooked")
        jump = hooked.select(F.col("id").alias("c"), F.col("c").alias("further"))
        new = save(hooked.join(jump, "c", "left").select("id", "was", F.coalesce("further", "c").alias("c")), "labels")
        moved = new.filter("c <> was").limit(1).count()
        forget(labels, hooked)
        labels = new
        if not moved:
            forget(both)
            return labels.select("id", F.col("c").alias("component"))
