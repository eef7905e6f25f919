"""Joins: context of a project, known cookies, token cost, drift against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.nodes import compound, select, subtree, text_of
from webloom.functions.text import content_key

# Cookies of bot defences, in order.
COOKIES = "_abck bm_sz ak_bmsc px3 pxvid cf_clearance datadome kasada incap_ses visid_incap".split()
# Price per million tokens, input and output, by exact model name.
PRICES = [
    ("gpt-4-turbo", 10.0, 30.0), ("gpt-4o", 5.0, 15.0), ("gpt-4o-mini", 0.15, 0.60),
    ("claude-3-5-sonnet", 3.0, 15.0), ("claude-3-opus", 15.0, 75.0), ("claude-3-haiku", 0.25, 1.25),
]


def context(projects: DataFrame, *others: DataFrame, key: str = "project_id") -> DataFrame:
    """Each project's row with the rows of the other tables, null where they have none."""
    for other in others:
        projects = projects.join(other, key, "left")
    return projects


def inside(parsed: DataFrame, outer: str, inner: str) -> DataFrame:
    """(page_id, outer_id, node_id, tag, text): nodes matching `inner` strictly inside each node matching `outer`.

    An interval join of node ids with subtrees: a subtree is a slice of the page's nodes, so no row meets another.
    """
    n = F.col("nodes")
    own = parsed.select("page_id", F.explode(F.transform(select(n, outer), lambda o: subtree(n, o))).alias("o"))
    one = lambda x: F.struct(F.col("o")[0]["node_id"].alias("outer_id"), x["node_id"].alias("node_id"), x["tag"].alias("tag"), text_of(F.col("o"), x).alias("text"))
    found = F.filter("o", lambda x: (x["node_id"] != F.col("o")[0]["node_id"]) & compound(x, inner))
    return own.select("page_id", F.explode(F.transform(found, one)).alias("r")).select("page_id", "r.*")


def known_cookies(names: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, COOKIES)), F.transform(names, F.lower))


def token_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with cost; a model without a price costs nothing."""
    if prices is None:
        prices = F.broadcast(usage.sparkSession.createDataFrame(PRICES, "model string, input_price double, output_price double"))
    cost = F.col("input_tokens") / 1e6 * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") / 1e6 * F.coalesce("output_price", F.lit(0.0))
    return usage.join(prices, "model", "left").select(*usage.columns, cost.alias("cost"))


def drift(expected: DataFrame, actual: DataFrame, project: str, fields: list[str], limit: float = 0.1) -> DataFrame:
    """(project, expected, missing, rate, ok): share of a baseline's distinct records that the actual ones lack."""
    keyed = lambda df: df.select(F.col(project).alias("project"), content_key([F.col(f) for f in fields]).alias("key")).distinct()
    found = keyed(actual).withColumn("hit", F.lit(1))
    both = keyed(expected).join(found, ["project", "key"], "left").groupBy("project")
    out = both.agg(F.count("*").alias("expected"), F.count_if(F.col("hit").isNull()).alias("missing"))
    rate = F.col("missing") / F.col("expected")
    return out.select(F.col("project").alias(project), "expected", "missing", rate.alias("rate"), (rate < limit).alias("ok"))
