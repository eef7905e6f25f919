"""Page analysis over node arrays (column `nodes`) and over the node table they explode to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.nodes import compound, html_nodes, select, subtree, text_of
from webloom.functions.text import contains_any, selector, strip

SAFE = r"^[a-zA-Z0-9_-]+$"
# Tags that are no repeating section, and parents whose text is no field.
NO_SECTION = "script style noscript svg link meta nav footer header".split()
NO_TEXT = ["script", "style", "noscript"]
# Texts of next-page links, and what the page parameter of a url is called.
NEXT_TEXTS = ["next", "next page", ">", "»"]
URL_PARAM = "guessed_from_url"
# Selectors and phrases of sign-in walls, bot defence scripts.
LOGIN = ['a[href*="login"]', 'a[href*="signin"]', 'a[href*="sign-in"]', 'a[href*="account"]', 'button[id*="login"]', 'button[id*="signin"]', 'a[id*="nav-link-accountList"]', 'a[data-nav-ref*="sign"]', "#nav-signin-tooltip", ".sign-in-tooltip"]
AUTH = ["[data-requires-auth]", ".requires-login", "[data-login-required]"]
PHRASES = ["sign in to continue", "login to view", "please log in", "authentication required", "sign in for price", "sign in to see"]
BLUR, OVERLAY = ['[class*="blur"]', '[style*="blur"]'], ['[class*="overlay"]', '[class*="modal"][data-auth]']
DEFENCE = "akamai perimeterx px-cdn datadome kasada botd fingerprint challenge".split()


def parse_pages(pages: DataFrame, keep: list[str] = ("page_id", "url")) -> DataFrame:
    """pages with `nodes` in place of `html`."""
    return pages.select(*keep, html_nodes("html").alias("nodes"))


def node_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")


def safe_classes(classes: Column) -> Column:
    return F.filter(classes, lambda c: c.rlike(SAFE))


def _matching(css: str):
    return lambda n: compound(n, css)


def count(nodes: Column, *selectors: str) -> Column:
    """Matches of each selector, summed."""
    out = F.lit(0)
    for s in selectors:
        out = out + F.size(F.filter(nodes, _matching(s)))
    return out


def any_match(nodes: Column, *selectors: str) -> Column:
    out = F.lit(False)
    for s in selectors:
        out = out | F.exists(nodes, _matching(s))
    return F.coalesce(out, F.lit(False))


def next_selector(nodes: Column) -> Column:
    """Selector of the first next-page link or button that yields one."""

    def found(n: Column) -> Column:
        named = F.coalesce(F.lower(n["label"]).isin(NEXT_TEXTS), F.lit(False))
        return n["tag"].isin("a", "button") & (named | F.exists(n["classes"], lambda c: c.contains("next")))

    def name(n: Column) -> Column:
        by_text = F.when(F.lower(n["label"]) == "next", F.concat(n["tag"], F.lit(":contains('Next')")))
        by_class = F.when(F.size(n["classes"]) > 0, F.concat(F.lit("."), F.array_join(n["classes"], ".")))
        return F.coalesce(F.when(n["id"] != "", F.concat(F.lit("#"), n["id"])), by_class, by_text)

    return F.get(F.array_compact(F.transform(F.filter(nodes, found), name)), F.lit(0))


def pagination(nodes: Column, url: Column) -> Column:
    """struct<detected, type, selector, param>."""
    button = next_selector(nodes)
    in_url = F.coalesce(url.contains("page=") | url.contains("/p/"), F.lit(False))
    kind = F.when(button.isNotNull(), "next_button").when(in_url, "url_param").otherwise("none")
    param = F.when(button.isNull() & in_url, URL_PARAM)
    return F.struct((kind != "none").alias("detected"), kind.alias("type"), button.alias("selector"), param.alias("param"))


def stats(nodes: Column) -> Column:
    depth = F.transform(nodes, lambda n: n["depth"])
    total = F.aggregate(depth, F.lit(0).cast("long"), lambda a, d: a + d)
    return F.struct(F.size(nodes).alias("node_count"), F.try_divide(total, F.size(nodes)).alias("avg_depth"), F.array_max(depth).alias("max_depth"))


def nav_ratio(nodes: Column) -> Column:
    links = F.filter(nodes, lambda n: n["tag"] == "a")
    return F.coalesce(F.try_divide(F.size(F.filter(links, lambda n: n["in_chrome"])), F.size(links)), F.lit(0.0))


def accessibility(nodes: Column) -> Column:
    return F.struct(
        any_match(nodes, "[aria-label]", "[aria-labelledby]").alias("has_aria_labels"),
        any_match(nodes, '[role="list"]', '[role="article"]', '[role="main"]').alias("has_roles"),
    )


def iframes(nodes: Column) -> Column:
    own = F.filter(nodes, lambda n: n["tag"] == "iframe")
    sources = F.filter(F.transform(own, lambda n: n["attrs"]["src"]), lambda s: s != "")
    return F.struct(F.size(own).alias("count"), F.transform(F.slice(sources, 1, 5), lambda s: F.substring(s, 1, 100)).alias("sources"))


def lazy_images(nodes: Column) -> Column:
    return F.size(F.filter(nodes, lambda n: compound(n, 'img[loading="lazy"]') | compound(n, "img[data-src]")))


def anti_bot(nodes: Column) -> Column:
    title = F.exists(nodes, lambda n: (n["tag"] == "title") & text_of(nodes, n).contains("Cloudflare"))
    return F.struct(
        any_match(nodes, 'iframe[src*="captcha"]', '[id*="captcha"]').alias("captcha"),
        any_match(nodes, '[id*="cookie"]', '[class*="cookie"]').alias("cookie_wall"),
        (F.coalesce(title, F.lit(False)) | any_match(nodes, "#cf-wrapper")).alias("cloudflare"),
    )


def framework(nodes: Column) -> Column:
    return F.when(any_match(nodes, "[data-v-]"), "vue").when(any_match(nodes, "[ng-version]"), "angular").otherwise("unknown")


def signin(nodes: Column) -> Column:
    texts = F.filter(nodes, lambda n: ~n["tag"].isin(NO_TEXT))
    text = F.lower(F.array_join(F.flatten(F.transform(texts, lambda n: F.transform(n["texts"], lambda t: t["s"]))), " "))
    return F.struct(
        count(nodes, *LOGIN).alias("login_links"),
        count(nodes, *AUTH).alias("auth_blocks"),
        contains_any(text, PHRASES).alias("auth_text"),
        count(nodes, *BLUR).alias("blurred"),
        count(nodes, *OVERLAY).alias("overlays"),
    )


def defence(nodes: Column) -> Column:
    sources = F.transform(F.filter(nodes, lambda n: n["tag"] == "script"), lambda n: n["attrs"]["src"])
    known = F.filter(sources, lambda s: contains_any(F.lower(s), DEFENCE))
    style = lambda n: F.replace(F.lower(F.coalesce(n["attrs"]["style"], F.lit(""))), F.lit(" "), F.lit(""))
    hidden = lambda n: style(n).contains("display:none") | style(n).contains("visibility:hidden") | F.coalesce(n["attrs"]["aria-hidden"] == "true", F.lit(False))
    return F.struct(
        F.array_sort(F.array_distinct(F.transform(known, lambda s: F.substring(s, 1, 50)))).alias("scripts"),
        F.size(F.filter(nodes, lambda n: (n["tag"] == "input") & hidden(n))).alias("honeypots"),
    )


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also where `use` names it inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def common_kinds(nodes: Column, most: int) -> Column:
    """The most common kinds of nodes, ties by first appearance: array<struct<less, first, tag, safe>>, less = -count.

    A kind is a tag and its sorted safe classes. Nodes are sorted by kind, so that each kind is one run: its length is
    the count, its first node the first appearance. No node is compared with every kind.
    """
    safe = lambda x: F.sort_array(safe_classes(x["classes"]))
    kinds = F.transform(F.filter(nodes, lambda x: ~x["tag"].isin(NO_SECTION)), lambda x: F.struct(x["tag"].alias("tag"), safe(x).alias("safe"), x["node_id"].alias("at")))
    sorted_kinds = F.sort_array(F.filter(kinds, lambda k: F.size(k["safe"]) > 0))

    def runs(keys: Column) -> Column:
        begins = lambda k, i: ~F.coalesce((F.get(keys, i - 1)["tag"] == k["tag"]) & (F.get(keys, i - 1)["safe"] == k["safe"]), F.lit(False))
        starts = F.filter(F.transform(keys, lambda k, i: F.when(begins(k, i), i)), lambda i: i.isNotNull())

        def kind(own: Column) -> Column:
            length = lambda i, k: F.coalesce(F.get(own, k + 1), F.size(keys)) - i
            return F.transform(own, lambda i, k: F.struct((-length(i, k)).alias("less"), keys[i]["at"].alias("first"), keys[i]["tag"].alias("tag"), keys[i]["safe"].alias("safe")))

        return bound(starts, kind)

    return F.slice(F.sort_array(bound(sorted_kinds, runs)), 1, most)


def sections(parsed: DataFrame, candidates: int = 30, least: int = 2, most: int = 12) -> DataFrame:
    """Repeating sections of parsed pages: (page_id, rank, type, selector, count, score, fields), best first.

    Nodes of one tag and one set of safe classes are a group; the most common groups whose first matching element is
    rich, or has text, and yields fields are scored by fields times the root of their count. A page is worked on within
    its row: only the candidate groups' first elements leave it. Fields are texts in document order, then links, then
    images; the first of each css stays.
    """
    n, inside = F.col("nodes"), F.col("inside")
    top = parsed.select("page_id", "nodes", common_kinds(n, candidates).alias("top"))

    def example(g: Column) -> Column:
        found = F.filter(n, lambda x: (x["tag"] == g["tag"]) & (F.size(F.array_except(g["safe"], x["classes"])) == 0))
        return subtree(n, found[0])

    found = F.transform(F.filter("top", lambda g: -g["less"] > least), lambda g: F.struct(g.alias("g"), example(g).alias("inside")))
    rows = top.select("page_id", F.posexplode(found).alias("order", "x")).select("page_id", "order", "x.g.tag", "x.g.safe", (-F.col("x.g.less")).cast("long").alias("count"), "x.inside")
    css = lambda x: selector(x["tag"], safe_classes(x["classes"]))
    field = lambda phase, at, name, x, value: F.struct(F.lit(phase).alias("phase"), at.alias("at"), F.lit(name).alias("name"), css(x).alias("css"), F.substring(value, 1, 50).alias("sample"))

    def texts(x: Column) -> Column:
        stripped = F.transform(x["texts"], lambda t: F.struct(t["at"].alias("at"), strip(t["s"]).alias("s")))
        return F.transform(F.filter(stripped, lambda t: (F.length(t["s"]) > 1) & (F.length(t["s"]) < 250)), lambda t: field(1, t["at"], "text_field", x, t["s"]))

    below = lambda x, tag, attr: (x["tag"] == tag) & (x["node_id"] != inside[0]["node_id"]) & F.map_contains_key(x["attrs"], attr)
    parts = F.concat(
        F.flatten(F.transform(F.filter(inside, lambda x: ~x["tag"].isin(NO_TEXT)), texts)),
        F.transform(F.filter(inside, lambda x: below(x, "a", "href")), lambda x: field(2, x["node_id"], "link", x, x["attrs"]["href"])),
        F.transform(F.filter(inside, lambda x: below(x, "img", "src")), lambda x: field(3, x["node_id"], "image", x, x["attrs"]["src"])),
    )
    kids = F.transform(F.filter(inside, lambda x: x["parent_id"] == inside[0]["node_id"]), lambda x: x["tag"])
    rows = rows.select("page_id", "order", "tag", "safe", "count", F.sort_array(parts).alias("parts"), kids.alias("kids"), F.length(text_of(inside, inside[0])).alias("chars"))
    # The first of each css: parts sorted by css keep their order within it, so that only its first differs from the one before.
    by_css = F.sort_array(F.transform("parts", lambda f: F.struct(f["css"].alias("css"), f["phase"].alias("phase"), f["at"].alias("at"), f["name"].alias("name"), f["sample"].alias("sample"))))
    firsts = bound(by_css, lambda p: F.filter(p, lambda f, i: ~F.coalesce(F.get(p, i - 1)["css"] == f["css"], F.lit(False))))
    in_order = F.sort_array(F.transform(firsts, lambda f: F.struct(f["phase"].alias("phase"), f["at"].alias("at"), f["name"].alias("name"), f["css"].alias("css"), f["sample"].alias("sample"))))
    first = rows.withColumn("fields", in_order)
    rich = (F.size("kids") >= 2) & (F.size(F.array_distinct("kids")) >= 2)
    scored = first.filter((F.size("fields") > 0) & (rich | (F.col("chars") >= 5))).withColumn("score", F.size("fields") * F.sqrt("count"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "order"))).filter(F.col("rank") <= most)
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["css"].alias("css"), f["sample"].alias("sample")))
    return scored.select("page_id", "rank", F.lit("repeating_list").alias("type"), selector(F.col("tag"), F.col("safe")).alias("selector"), "count", "score", fields.alias("fields"))


def best_unit(parsed: DataFrame, least: int = 5) -> DataFrame:
    """The most common (tag, all classes) of each page with more than `least` nodes."""
    nodes = node_table(parsed).filter(F.size("classes") > 0)
    groups = nodes.groupBy("page_id", F.upper("tag").alias("tag"), F.array_sort("classes").alias("classes")).agg(F.count("*").alias("count"), F.min("node_id").alias("first"))
    best = groups.filter(F.col("count") > least).groupBy("page_id").agg(F.max_by(F.struct("tag", "classes", "count"), F.struct("count", -F.col("first"))).alias("b"))
    return best.select("page_id", "b.tag", "b.classes", "b.count")


def tree_export(parsed: DataFrame, most: int = 500) -> DataFrame:
    """(page_id, parent_id, node_id, tag, text): nodes with at most `most` children of each parent, and a marker row for the others.

    What is inside a node that is left out is left out too.
    """
    n = F.col("nodes")
    end = lambda x: F.coalesce(F.get(n, x["parent_id"])["subtree_end"], F.size(n))
    cut = F.transform(F.filter(n, lambda x: x["place"] == most + 1), lambda x: F.struct(x["node_id"].alias("first"), end(x).alias("end")))
    parsed = parsed.select("page_id", "nodes", cut.alias("cut"))  # once a page, not once a node
    out = lambda x, first=0: F.exists("cut", lambda c: (c["first"] + first <= x["node_id"]) & (x["node_id"] < c["end"]))
    row = lambda parent, node, tag, text: F.struct(parent.alias("parent_id"), node.alias("node_id"), tag.alias("tag"), text.alias("text"))
    leaf = lambda x: F.when(x["subtree_end"] == x["node_id"] + 1, F.substring(text_of(n, x), 1, 50))
    kept = F.transform(F.filter(n, lambda x: ~out(x)), lambda x: row(x["parent_id"], x["node_id"], x["tag"], leaf(x)))
    over = F.filter(n, lambda x: (x["place"] == most + 1) & ~out(x, 1))
    rest = lambda x: F.size(F.filter(n, lambda y: y["parent_id"].eqNullSafe(x["parent_id"]))) - most
    marks = F.transform(over, lambda x: row(x["parent_id"], F.lit(None).cast("int"), F.lit("#more"), F.format_string("... %d more items ...", rest(x))))
    return parsed.select("page_id", F.explode(F.concat(kept, marks)).alias("r")).select("page_id", "r.*")


def stable_selector(parsed: DataFrame) -> DataFrame:
    """(page_id, node_id, css): #id, else a test id or label, else a path of tags and positions."""
    n = F.col("nodes")

    def path(x: Column) -> Column:
        """Steps from the node up to the root, by parent ids."""
        at = lambda acc: n[acc["at"]]
        step = lambda acc: F.concat(at(acc)["tag"], F.lit(":nth-of-type("), at(acc)["nth"], F.lit(")"))
        start = F.struct(x["node_id"].alias("at"), F.array().cast("array<string>").alias("steps"))
        up = lambda acc, _: F.struct(F.coalesce(at(acc)["parent_id"], acc["at"]).alias("at"), F.array_append(acc["steps"], step(acc)).alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), x["depth"]), start, up, lambda acc: F.array_join(F.reverse(acc["steps"]), " > "))

    def css(x: Column) -> Column:
        named = [F.when(x["attrs"][k].isNotNull(), F.concat(F.lit(f'[{k}="'), x["attrs"][k], F.lit('"]'))) for k in ("data-testid", "data-qa", "aria-label")]
        return F.coalesce(F.when(x["id"] != "", F.concat(F.lit("#"), x["id"])), *named, path(x))

    found = F.transform(n, lambda x: F.struct(x["node_id"].alias("node_id"), css(x).alias("css")))
    return parsed.select("page_id", F.explode(found).alias("r")).select("page_id", "r.*")


def value_of(nodes: Column, node: Column, kind: str = "text") -> Column:
    """The value of a node of `nodes`: the title attribute before the text; src of images; href of links."""
    if kind in ("image", "link"):
        return node["attrs"]["src" if kind == "image" else "href"]
    return F.coalesce(node["attrs"]["title"], text_of(nodes, node))


def select_nodes(parsed: DataFrame, css: str) -> DataFrame:
    return parsed.withColumn("found", select(F.col("nodes"), css))
