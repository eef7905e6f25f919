"""Filters, predicates and classifiers on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import contains_any, reasons, valid_url

# Block pages, tested on lower-cased html in this order (all terms of the last are needed).
BLOCKS = [
    ("Cloudflare Challenge", ["cloudflare", "ray id", "checking your browser"]),
    ("Akamai/WAF Block", ["akamai", "access denied", "reference #"]),
    ("PerimeterX CAPTCHA", ["px-captcha", "perimeterx"]),
    ("Generic Bot Detection", ["bot detection", "automated access"]),
]
# Technologies and the case-sensitive substrings that show them.
TECHNOLOGIES = [
    ("React", ["react", "__REACT"]), ("Next.js", ["__NEXT_DATA__"]), ("Vue.js", ["vue", "__vue__"]),
    ("WordPress", ["wp-content"]), ("Shopify", ["shopify"]), ("Cloudflare", ["cloudflare"]),
]
FORMATS, MODES = ["json", "csv", "xlsx"], ["headless", "headed"]
# Error classes by substrings of the lower-cased message, in order, and those worth a repair.
ERRORS = [
    ("timeout_error", ["timeouterror"]), ("syntax_error", ["syntaxerror", "indentationerror"]),
    ("selector_error", ["waiting for selector", "element not found"]), ("network_error", ["network", "connection refused"]),
]
RECOVERABLE = ["syntax_error", "selector_error", "timeout_error"]


def drop_empty(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records with at least one field that is not null."""
    return records.dropna(how="all", subset=fields)


def split_failures(items: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good items without the error column, failed items)."""
    return items.filter(F.col(error).isNull()).drop(error), items.filter(F.col(error).isNotNull())


def request_violations(url: Column, max_pages: Column, kind: Column, mode: Column) -> Column:
    """Names of the rules that a request breaks; empty for an admitted one. A null breaks the rule on its field."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    return reasons(
        (bad(url.rlike("^https?://")), "url_scheme"),
        (F.coalesce(url.contains("localhost") | url.contains("127.0.0.1"), F.lit(False)), "url_local"),
        (bad((max_pages >= 1) & (max_pages <= 1000)), "max_pages"),
        (bad(kind.isin(FORMATS)), "format"),
        (bad(mode.isin(MODES)), "mode"),
    )


def block_reasons(html: Column) -> Column:
    """Why a page looks like a block or challenge page; empty for a healthy one."""
    low = F.lower(html)
    amazon = F.coalesce(low.contains("amazon") & low.contains("robot"), F.lit(False))
    return reasons(*((contains_any(low, terms), name) for name, terms in BLOCKS), (amazon, "Amazon Robot Check"))


def technologies(html: Column) -> Column:
    return reasons(*((contains_any(html, terms), name) for name, terms in TECHNOLOGIES))


def is_api(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"/api/|graphql|\.json|query"), F.lit(False))


def is_json(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("application/json"), F.lit(False))


def is_websocket(upgrade: Column) -> Column:
    return F.coalesce(F.lower(upgrade) == "websocket", F.lit(False))


def confident(possible: Column, confidence: Column, least: float = 0.5) -> Column:
    return F.coalesce(possible, F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= least)


def choose_fields(available: Column, unattended: bool = False) -> Column:
    """Names of the suggested fields of array<struct<name,suggested>>, else of the first five.

    Unattended runs take the first five names, or `item_title` and `item_price` where there are none.
    """
    names = F.transform(available, lambda f: f["name"])
    if unattended:
        return F.when(F.coalesce(F.size(available), F.lit(0)) > 0, F.slice(names, 1, 5)).otherwise(F.array(F.lit("item_title"), F.lit("item_price")))
    suggested = F.transform(F.filter(available, lambda f: F.coalesce(f["suggested"], F.lit(False))), lambda f: f["name"])
    return F.when(F.size(suggested) > 0, suggested).otherwise(F.slice(names, 1, 5))


def project_fields(records: DataFrame, fields: list[str], keep: list[str] = (), data: str = "fields") -> DataFrame:
    """Typed columns of the chosen keys of a map column; missing ones are null."""
    return records.select(*keep, *(F.try_element_at(F.col(data), F.lit(f)).alias(f) for f in fields))


def error_class(message: Column) -> Column:
    low, out = F.lower(message), F.lit("general_error")
    for name, terms in reversed(ERRORS):
        out = F.when(contains_any(low, terms), name).otherwise(out)
    return out


def admitted_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(valid_url(F.col(url)))
