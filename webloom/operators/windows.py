"""Windows, ordering and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import falsy, shorten


def stability(polls: DataFrame, key: str = "page_id", stable_ms: int = 800, most_ms: int = 5000) -> DataFrame:
    """(key, reached, stable_node_count, stability_reached_ms) of node-count polls (key, ts, node_count).

    A page is stable when its count has not changed for `stable_ms`, within `most_ms` of the first poll; otherwise the
    last count within the limit is given, with the limit.
    """
    order = Window.partitionBy(key).orderBy("ts")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    timed = polls.withColumn("at", ms - F.min(ms).over(Window.partitionBy(key))).filter(F.col("at") <= most_ms)
    changed = F.coalesce((F.col("node_count") != F.lag("node_count").over(order)).cast("int"), F.lit(1))
    islands = timed.withColumn("island", F.sum(changed).over(order))
    aged = islands.withColumn("age", F.col("at") - F.min("at").over(Window.partitionBy(key, "island")))
    good = F.col("age") >= stable_ms
    return aged.groupBy(key).agg(
        F.coalesce(F.bool_or(good), F.lit(False)).alias("reached"),
        F.coalesce(F.min_by("node_count", F.when(good, F.col("at"))), F.max_by("node_count", "at")).alias("stable_node_count"),
        F.coalesce(F.min(F.when(good, F.col("at"))), F.lit(most_ms)).cast("long").alias("stability_reached_ms"),
    )


def recent_projects(sessions: DataFrame, by: str = "updated_at") -> DataFrame:
    return sessions.withColumn("url", shorten(F.col("url"), 40)).orderBy(F.desc(by), "project_id")


def data_preview(records: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows, with long cells cut and missing values null."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    cells = [F.when(~falsy(F.col(c), kinds[c]), shorten(F.col(c).cast("string"), 40)).alias(c) for c in records.columns]
    return records.orderBy(*order).limit(rows).select(*cells)


def append(*results: DataFrame) -> DataFrame:
    """All rows of all results; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
