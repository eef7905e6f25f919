"""Extraction of records from parsed pages, paging scope, and user plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.nodes import Matches, compound, parse, parse_with_text, select, subtree, words_of
from webloom.operators.dom import value_of

# How many pages each scope reads.
SCOPES = {"first_page": 1, "limit_5": 5, "all_pages": 50}


def items(parsed: DataFrame, css: str, keep: list[str] = ("page_id",)) -> DataFrame:
    """All elements matching the list selector, in document order: keep, item_no and item, the nodes of its subtree."""
    found = F.transform(select(F.col("nodes"), css), lambda x: subtree(F.col("nodes"), x))
    return parsed.select(*keep, F.posexplode(found).alias("item_no", "item"))


def field(item: Column, css: str, kind: str = "text") -> Column:
    """Value of the first node matching a compound selector inside an item, or of the item itself; null if missing."""
    found = F.filter(item, lambda n: compound(n, css))
    return F.when(F.size(found) > 0, value_of(item, found[0], kind))


def records(parsed: DataFrame, css: str, fields: dict[str, tuple[str, str]], keep: list[str] = ("page_id",)) -> DataFrame:
    """One record per item; fields: name -> (compound selector, text | image | link)."""
    found = items(parsed, css, keep)
    return found.select(*keep, "item_no", *(field(F.col("item"), c, kind).alias(name) for name, (c, kind) in fields.items()))


# A template's nodes: lists give items, fields give an item's values, pagination gives the next page. `metadata` may
# say what a field's value is: kind (text, image or link) or attribute (its name).
TEMPLATE = "array<struct<name:string,type:string,selector_chain:array<string>,metadata:map<string,string>>>"
EXTRACTED = "items array<struct<list:string,item_no:int,fields:map<string,string>>>, next string, error string"


def _value(page: Matches, at: int, metadata: dict[str, str]) -> str | None:
    """What value_of() says of a node, of a page as the helper has it."""
    attrs, kind = page.attrs[at], metadata.get("kind", "text")
    if "attribute" in metadata or kind in ("image", "link"):
        return attrs.get(metadata.get("attribute") or {"image": "src", "link": "href"}[kind])
    return attrs["title"] if "title" in attrs else words_of(page.nodes, at)


def apply_template(page: Matches, template: list[dict]) -> tuple[list[dict], str | None]:
    """(items, next page) of a page by a template's nodes; a selector that is not supported is an error."""
    of = {kind: [t for t in template if t["type"] == kind] for kind in ("list", "field", "pagination")}
    if len(template) != sum(map(len, of.values())):
        raise ValueError(f"node types not supported: {sorted({str(t['type']) for t in template} - set(of))}")
    found = []
    for node in of["list"]:
        for no, at in enumerate(page.chain(node["selector_chain"])):
            values = []
            for f in of["field"]:
                hits = page.chain(f["selector_chain"], at)
                values.append((f["name"], _value(page, hits[0], dict(f["metadata"] or ())) if hits else None))
            found.append({"list": node["name"], "item_no": no, "fields": values})
    following = (_value(page, at, {"kind": "link"}) for p in of["pagination"] for at in page.chain(p["selector_chain"])[:1])
    return found, next((x for x in following if x is not None), None)


def from_templates(pages: DataFrame, templates: DataFrame, site: str = "site") -> DataFrame:
    """(page_id, site, items, next, error): every page (page_id, site, html) by its site's template (site, nodes).

    Templates are rows: pages meet theirs in a join, broadcast or not as Spark sees fit, and all templates together are
    one scan and one parse of the pages. A page without a template is left out. A template with a selector that is not
    supported fails its own pages, with the reason in `error`; a field without a match is null; what a page without
    html gives is nothing.
    """
    kind = pages.schema[site].dataType.simpleString()
    both = pages.select("page_id", site, "html").join(templates.select(site, F.col("nodes").cast(TEMPLATE).alias("nodes")), site)

    def run(batches):
        compiled: dict[str, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, items, following, errors = batch.slice(at, 64), [], [], []
                for html, nodes in zip(part.column("html").to_pylist(), part.column("nodes").to_pylist()):
                    try:
                        got, more, error = *apply_template(Matches(parse(html) or [], compiled), nodes or []), None
                    except ValueError as e:
                        got, more, error = [], None, str(e)
                    items.append(got)
                    following.append(more)
                    errors.append(error)
                item = pa.struct([("list", pa.string()), ("item_no", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column(site), pa.array(items, pa.list_(item)), pa.array(following, pa.string()), pa.array(errors, pa.string())], ["page_id", site, "items", "next", "error"])

    page = pages.schema["page_id"].dataType.simpleString()
    return both.select("page_id", site, "html", "nodes").mapInArrow(run, f"page_id {page}, `{site}` {kind}, {EXTRACTED}")


def template_records(extracted: DataFrame, site: str = "site") -> DataFrame:
    """(page_id, site, list, item_no, fields) of from_templates()."""
    return extracted.select("page_id", site, F.explode("items").alias("x")).select("page_id", site, "x.*")


def max_pages(scope: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in SCOPES.items():
        out = F.when(scope == name, n).otherwise(out)
    return out


def paging_walk(pages: DataFrame, project: str, page_no: str, has_next: str, most: int | Column) -> DataFrame:
    """Pages that a walk reads: each following page while the page before has a next one, at most `most`."""
    order = Window.partitionBy(project).orderBy(page_no)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    go_on = F.coalesce(F.min(F.coalesce(F.col(has_next), F.lit(False))).over(before), F.lit(True))
    walked = pages.withColumn("_n", F.row_number().over(order)).withColumn("_go", go_on)
    return walked.filter((F.col("_n") <= most) & F.col("_go")).drop("_n", "_go")


def preview(found: DataFrame, project: str = "page_id") -> DataFrame:
    """The first item of each project's first page."""
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(project).orderBy("item_no"))).filter("_k = 1").drop("_k")


def parsed_items(html: str | None, get_items: Callable[[list[dict]], Iterable[Any]], parse_item: Callable[[Any], dict]) -> Iterator[tuple[int, str | None, dict]]:
    """(item_no, error, values) of a page by a user's functions."""
    try:
        found = list(get_items(parse_with_text(html)))
    except Exception as e:  # noqa: BLE001  the user's code
        yield -1, f"{type(e).__name__}: {e}", {}
        return
    for no, item in enumerate(found):
        try:
            got = parse_item(item)
            got = {} if got is None else got
            bad = None if isinstance(got, dict) else f"TypeError: {type(got).__name__} is no dict"
        except Exception as e:  # noqa: BLE001
            got, bad = {}, f"{type(e).__name__}: {e}"
        yield no, bad, got if bad is None else {}


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def extract_with(pages: DataFrame, get_items: Callable[[list[dict]], Iterable[Any]], parse_item: Callable[[Any], dict], fields: list[str]) -> DataFrame:
    """User plug-in: (page_id, item_no, error, fields...) with text values.

    get_items takes a page's node list, parse_item an item; an exception or a result that is no dict fails its item
    alone, with the reason in `error`, and an exception of get_items fails its page as item -1. An item of which
    parse_item gives None, or no value, has no data: a row of nulls without an error, which drop_empty() takes out.
    """

    def run(batches):
        for batch in batches:
            rows = [(page_id, *r) for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for r in parsed_items(html, get_items, parse_item)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())]
            columns += [pa.array([_text(r[3].get(f)) for r in rows], pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "item_no", "error", *fields])

    schema = ", ".join(["page_id long, item_no int, error string", *(f"`{f}` string" for f in fields)])
    return pages.select("page_id", "html").mapInArrow(run, schema)


def register_plugin(spark: SparkSession, name: str, get_items: Callable[[list[dict]], Iterable[Any]], parse_item: Callable[[Any], dict], fields: list[str]) -> None:
    """A user plug-in as a table function for SQL: `FROM pages, LATERAL name(html)` gives item_no, error and the fields.

    Rows are those of extract_with() for the page.
    """

    class Plugin:
        def eval(self, html: str):
            for no, bad, got in parsed_items(html, get_items, parse_item):
                yield (no, bad, *(_text(got.get(f)) for f in fields))

    kinds = ", ".join(["item_no int, error string", *(f"`{f}` string" for f in fields)])
    spark.udtf.register(name, F.udtf(Plugin, returnType=kinds))
