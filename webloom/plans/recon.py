"""Workflows that put the operators together: page reconnaissance and record collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import site_key
from webloom.operators import aggregates, dom, extract, filters, joins, scoring


def page_signals(pages: DataFrame) -> DataFrame:
    """One row per page with all signals that its html shows; html is parsed once."""
    health = pages.select("page_id", "url", "html", filters.block_reasons(F.col("html")).alias("block_reasons"), filters.technologies(F.col("html")).alias("technologies"))
    parsed = dom.parse_pages(health, ["page_id", "url", "block_reasons", "technologies"])
    n = F.col("nodes")
    return parsed.select(
        "page_id", "url", "block_reasons", "technologies", dom.pagination(n, F.col("url")).alias("pagination"), dom.stats(n).alias("stats"),
        dom.nav_ratio(n).alias("nav_ratio"), dom.accessibility(n).alias("accessibility"), dom.iframes(n).alias("iframes"), dom.lazy_images(n).alias("lazy_images"),
        dom.anti_bot(n).alias("anti_bot"), dom.framework(n).alias("framework"), dom.signin(n).alias("signin"), dom.defence(n).alias("defence"),
    )


def quiet() -> dict[str, Column]:
    """The signals that a page's behaviour gives, with their values where they were not recorded."""
    none = F.array().cast("array<string>")
    return {"cookies": none, "mutation_rate": F.lit(0.0), "grows": F.lit(False), "shadow_dom": F.lit(False), "sse": F.lit(False)}


def recon(pages: DataFrame, requests: DataFrame | None = None, behaviour: DataFrame | None = None) -> DataFrame:
    """Signals with network activity, scores, browser mode and route.

    requests: network log rows. behaviour: a row per page with page_id and any of cookies (names), mutation_rate (a
    second), grows (on scrolling), shadow_dom and sse.
    """
    signals = page_signals(pages)
    if requests is not None:
        signals = signals.join(aggregates.network_activity(requests), "page_id", "left")
    else:
        signals = signals.withColumns({"request_count": F.lit(0).cast("long"), "realtime": F.lit(0).cast("long"), "api_endpoints": F.array().cast("array<string>"), "has_challenge": F.lit(False)})
    if behaviour is not None:
        signals = signals.join(behaviour.select("page_id", *(c for c in quiet() if c in behaviour.columns)), "page_id", "left")
    signals = signals.withColumns({c: F.coalesce(c, value) if c in signals.columns else value for c, value in quiet().items()})
    none = F.array().cast("array<string>")
    cloudflare = F.col("anti_bot.cloudflare")
    scored = signals.withColumns(
        {
            "complexity": scoring.complexity(F.col("anti_bot.captcha"), cloudflare, F.col("framework"), F.col("mutation_rate"), F.col("grows")),
            "hostility": scoring.hostility(joins.known_cookies(F.col("cookies")), F.col("defence.scripts"), F.col("defence.honeypots"), none, F.col("has_challenge")),
            "signin_score": scoring.signin_likelihood(F.col("signin"), F.col("url")),
        }
    )
    live = F.col("sse") | (F.coalesce("realtime", F.lit(0)) > 0)
    mode = scoring.browser_mode(F.col("anti_bot.captcha"), cloudflare, F.col("stats.node_count"), F.coalesce("request_count", F.lit(0)), F.col("shadow_dom"), live)
    out = scored.withColumn("scores", scoring.merged(F.col("complexity"), F.col("hostility"), F.col("signin_score")))
    return out.withColumns({"browser_mode": mode, "route": scoring.route(F.size("block_reasons") > 0, F.col("anti_bot.captcha"), F.lit(False))})


def site_summary(pages: DataFrame) -> DataFrame:
    """Pages, blocked pages and paged URLs of each site; no html is parsed."""
    url = F.col("url")
    return pages.groupBy(site_key(url).alias("site")).agg(
        F.count("*").alias("pages"),
        F.count_if(F.size(filters.block_reasons(F.col("html"))) > 0).alias("blocked"),
        F.count_if(url.contains("page=") | url.contains("/p/")).alias("paged"),
    )


def collect(parsed: DataFrame, css: str, fields: dict[str, tuple[str, str]], project: str = "page_id") -> DataFrame:
    """Records of all items, without empty ones and repeated content of a project."""
    found = extract.records(parsed, css, fields, [project])
    return aggregates.dedup_records(filters.drop_empty(found, list(fields)), project, ["item_no"], list(fields))
