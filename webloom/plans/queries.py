"""The registered queries of the library's own operators, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text as fn
from webloom.functions.nodes import text_of
from webloom.operators import aggregates, dom, extract, filters, joins, scoring, windows
from webloom.plans import recon
from webloom.sources import readers, sinks
from webloom.sources.scratch import scratch
from webloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables by name; streams of them end when all rows are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def streamed(self, frame: DataFrame, build, conf: dict[str, str] | None = None) -> DataFrame:
        """The rows that build(stream of frame) gives in append mode, written out and read back."""
        path = scratch(self.spark, "stream")
        frame.write.parquet(f"{path}/in")
        before = {k: self.spark.conf.get(k, None) for k in conf or {}}
        for k, v in (conf or {}).items():
            self.spark.conf.set(k, v)
        try:
            live = build(self.spark.readStream.schema(frame.schema).parquet(f"{path}/in"))
            live.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        return self.spark.read.schema(live.schema).parquet(f"{path}/out")

    def arriving(self, parts: list[DataFrame], write) -> str:
        """The folder that a stream's writer, write(stream, folder), fills from parts that come one by one; it starts anew, from its checkpoint, for each."""
        path = scratch(self.spark, "arriving")
        for part in parts:
            part.write.mode("append").parquet(f"{path}/in")
            write(self.spark.readStream.schema(part.schema).parquet(f"{path}/in"), f"{path}/out").trigger(availableNow=True).start().awaitTermination()
        return f"{path}/out"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def has(column: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def joined(values):
    return F.array_join(values, "; ")


def named(*pairs: tuple[str, str]) -> str:
    """SQL for the names whose condition holds, joined by `; `."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + ")"


SITE = "replace(replace(split_part(split_part(url, '//', -1), '/', 1), 'www.', ''), '.', '_')"
BLOCKED = [(has("lower(html)", *terms), name) for name, terms in filters.BLOCKS] + [("contains(lower(html), 'amazon') AND contains(lower(html), 'robot')", "Amazon Robot Check")]


# Derived pages: markup that real captures hold and the given pages lack, placed by the page's own number k


def times(html: str, n: Column) -> Column:
    return F.repeat(F.lit(html), n.cast("int"))


def flavoured(t) -> DataFrame:
    """One page for each of `pages`, of the same id, with signals that follow from the id."""
    k = F.col("page_id")
    pick = lambda m, *parts: reduce(lambda out, p: out.when(k % m == p[0], p[1]), parts, F.when(F.lit(False), "")).otherwise("")
    title = F.when(k % 7 == 0, "Cloudflare check").otherwise("Shop")
    body = [
        F.lit("<nav>\n"), times('<a href="/n">n</a>', k % 4), F.lit("</nav>\n\t"), times('<a href="/c">c</a>', k % 3),
        times('<iframe src="/f.html"></iframe>', k % 4), pick(5, (0, '<iframe src="/captcha/x"></iframe>'), (1, '<script src="/static/DataDome.js"></script>')),
        times('<img data-src="a.png">', k % 3), pick(2, (1, '<img loading="lazy" src="b.png"><p aria-label="x">some text</p>')),
        pick(3, (1, '<div class="cookie-bar">ok</div>'), (2, '<div role="list">list</div>')), pick(4, (1, '<div ng-version="17">x</div>'), (2, "<div data-v->x</div>")),
        times('<a href="/login">in</a>', k % 3), pick(6, (0, '<p class="blurred">x</p>'), (1, '<div class="overlay">x</div>'), (2, "<p>Please Log in</p>"), (3, "<div data-requires-auth>x</div>")),
        times('<input style="display: none">', k % 3),
        pick(8, (1, '<a class="pager next" href="?p">\n\tNext \n</a>'), (2, '<button id="more">Next Page</button>'), (3, "<a>\r\n Next</a>")),
        pick(9, (0, "<p>Checking your Browser</p>"), (1, "<p>Access Denied</p>"), (2, "<p>PerimeterX</p>"), (3, "<p>Automated access</p>"), (4, "<p>Amazon robot</p>")),
        pick(10, (0, "<p>wp-content react</p>"), (1, "<p>__NEXT_DATA__</p>"), (2, "<p>shopify vue</p>"), (3, "<p>React</p>")),
    ]
    url = F.when(k % 11 == 0, "https://www.LinkedIn.com/in").when(k % 11 == 1, "https://x.example/list?page=2").when(k % 11 == 2, "https://x.example/p/3").otherwise("https://x.example/")
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), *body, F.lit("</body></html>"))
    return t("pages").select("page_id", url.alias("url"), html.alias("html"))


# Pages: predicates and tags on raw text


@query(f"SELECT {SITE} AS site, count(*) AS pages, count(*) FILTER (WHERE {' OR '.join(c for c, _ in BLOCKED)}) AS blocked, count(*) FILTER (WHERE contains(url, 'page=') OR contains(url, '/p/')) AS paged FROM pages GROUP BY 1")
def site_summary(t):
    return recon.site_summary(t("pages"))


@query(f"SELECT page_id, {SITE} AS site, CASE WHEN length(url) > 40 THEN substr(url, 1, 37) || '...' ELSE url END AS short_url FROM pages")
def site_key(t):
    return t("pages").select("page_id", fn.site_key(F.col("url")).alias("site"), fn.shorten(F.col("url"), 40).alias("short_url"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#]+')")
def valid_urls(t):
    return filters.admitted_urls(t("pages")).select("page_id", "url")


@query(
    "SELECT page_id, "
    + named(
        ("NOT starts_with(u, 'http://') AND NOT starts_with(u, 'https://')", "url_scheme"), ("contains(u, 'localhost') OR contains(u, '127.0.0.1')", "url_local"),
        ("page_id % 1500 NOT BETWEEN 1 AND 1000", "max_pages"), ("page_id % 4 = 3", "format"), ("page_id % 3 = 2", "mode"),
    )
    + " AS violations FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ftp://x' WHEN 1 THEN 'http://localhost/' ELSE url END AS u FROM pages)"
)
def request_admission(t):
    k = F.col("page_id")
    url = F.when(k % 5 == 0, "ftp://x").when(k % 5 == 1, "http://localhost/").otherwise(F.col("url"))
    kind = F.element_at(F.array(*map(F.lit, ["json", "csv", "xlsx", "pdf"])), (k % 4 + 1).cast("int"))
    mode = F.element_at(F.array(*map(F.lit, ["headless", "headed", "other"])), (k % 3 + 1).cast("int"))
    return t("pages").select("page_id", joined(filters.request_violations(url, k % 1500, kind, mode)).alias("violations"))


@query(
    "SELECT page_id, concat_ws('; ', CASE WHEN page_id % 9 = 0 OR page_id % 7 = 0 THEN 'Cloudflare Challenge' END, CASE WHEN page_id % 9 = 1 THEN 'Akamai/WAF Block' END, CASE WHEN page_id % 9 = 2 THEN 'PerimeterX CAPTCHA' END, "
    "CASE WHEN page_id % 9 = 3 THEN 'Generic Bot Detection' END, CASE WHEN page_id % 9 = 4 THEN 'Amazon Robot Check' END) AS reasons, page_id % 9 < 5 OR page_id % 7 = 0 AS blocked FROM pages"
)
def page_health(t):
    why = filters.block_reasons(F.col("html"))
    return flavoured(t).select("page_id", joined(why).alias("reasons"), (F.size(why) > 0).alias("blocked"))


@query(
    "SELECT page_id, concat_ws('; ', CASE WHEN page_id % 10 = 0 THEN 'React' END, CASE WHEN page_id % 10 = 1 THEN 'Next.js' END, CASE WHEN page_id % 10 = 2 THEN 'Vue.js' END, "
    "CASE WHEN page_id % 10 = 0 THEN 'WordPress' END, CASE WHEN page_id % 10 = 2 THEN 'Shopify' END) AS technologies FROM pages"
)
def tech_tags(t):
    return flavoured(t).select("page_id", joined(filters.technologies(F.col("html"))).alias("technologies"))


@query(f"SELECT page_id, {named(*BLOCKED)} AS reasons, {named(*((has('html', *terms), name) for name, terms in filters.TECHNOLOGIES))} AS technologies FROM pages")
def given_page_tags(t):
    html = F.col("html")
    return t("pages").select("page_id", joined(filters.block_reasons(html)).alias("reasons"), joined(filters.technologies(html)).alias("technologies"))


ENDPOINTS = ["/api/items", "/GraphQL", "/data.JSON?x", "/list?q=1", "/search?Query=a"]


@query(
    "SELECT page_id, page_id % 5 <> 3 AS api, substr(CASE page_id % 5 " + " ".join(f"WHEN {i} THEN url || '{e}'" for i, e in enumerate(ENDPOINTS)) + " END || repeat('z', page_id % 300), 1, 200) AS endpoint FROM pages"
)
def api_endpoints(t):
    url = F.concat("url", F.element_at(F.array(*map(F.lit, ENDPOINTS)), (F.col("page_id") % 5 + 1).cast("int")), times("z", F.col("page_id") % 300))
    return t("pages").select("page_id", filters.is_api(url).alias("api"), F.substring(url, 1, 200).alias("endpoint"))


# Pages: node arrays


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^<>]*>')) AS node_count FROM pages")
def dom_node_count(t):
    return dom.parse_pages(t("pages")).select("page_id", F.size("nodes").cast("long").alias("node_count"))


COUNTS = "(SELECT p_partkey // 20 AS page_id, count(*) AS c FROM part GROUP BY 1)"


@query(f"SELECT page_id, round((3 + 19 * c) / (2 + 5 * c), 6) AS avg_depth, 4 AS max_depth, 2 + 5 * c AS node_count FROM {COUNTS}")
def dom_depth(t):
    s = dom.stats(F.col("nodes"))
    return dom.parse_pages(listings(t)).select("page_id", F.round(s["avg_depth"], 6).alias("avg_depth"), s["max_depth"].cast("long").alias("max_depth"), s["node_count"].cast("long").alias("node_count"))


@query("SELECT page_id, CASE WHEN n + 2 * c + b = 0 THEN 0 ELSE round(n / (n + 2 * c + b), 6) END AS nav_ratio FROM (SELECT page_id, page_id % 4 AS n, page_id % 3 AS c, CASE WHEN page_id % 8 IN (1, 3) THEN 1 ELSE 0 END AS b FROM pages)")
def nav_ratio(t):
    return dom.parse_pages(flavoured(t)).select("page_id", F.round(dom.nav_ratio(F.col("nodes")), 6).alias("nav_ratio"))


LINKS = r"regexp_extract_all(html, '(?i)<(?:a|button)(?:\s[^>]*)?>[^<]*')"
NEXT_BUTTON = (
    rf"(SELECT page_id, CASE WHEN id <> '' THEN '#' || id WHEN cls <> '' THEN '.' || regexp_replace(cls, '\s+', '.', 'g') WHEN label = 'next' THEN tag || ':contains(''Next'')' END AS name, i FROM ("
    rf"SELECT page_id, i, lower(regexp_extract(x, '^<(\w+)', 1)) AS tag, regexp_extract(x, '\sid=\"([^\"]*)\"', 1) AS id, regexp_extract(x, '\sclass=\"\s*([^\"]*?)\s*\"', 1) AS cls, lower(regexp_extract(x, '>\s*([^<]*?)\s*$', 1)) AS label "
    f"FROM (SELECT page_id, unnest({LINKS}) AS x, generate_subscripts({LINKS}, 1) AS i FROM pages)) WHERE label IN ('next', 'next page', '>', '»', '&gt;', '&raquo;') OR contains(cls, 'next'))"
)


@query(
    "WITH p AS (SELECT page_id, true AS given, url, b FROM pages LEFT JOIN (SELECT page_id, arg_min(name, i) AS b FROM " + NEXT_BUTTON + " WHERE name IS NOT NULL GROUP BY 1) USING (page_id) UNION ALL "
    "SELECT page_id, false, CASE page_id % 11 WHEN 1 THEN '?page=' WHEN 2 THEN '/p/' ELSE '' END, CASE page_id % 8 WHEN 1 THEN '.pager.next' WHEN 2 THEN '#more' WHEN 3 THEN 'a:contains(''Next'')' END FROM pages) "
    "SELECT page_id, given, CASE WHEN b IS NOT NULL THEN 'next_button' WHEN contains(url, 'page=') OR contains(url, '/p/') THEN 'url_param' ELSE 'none' END AS type, b AS selector, "
    "CASE WHEN b IS NULL AND (contains(url, 'page=') OR contains(url, '/p/')) THEN 'guessed_from_url' END AS param FROM p"
)
def pagination_type(t):
    """Of each given page by its own url and html, and of each derived one."""
    p = dom.pagination(F.col("nodes"), F.col("url"))
    pages = t("pages").select("page_id", "url", "html", F.lit(True).alias("given")).unionByName(flavoured(t).withColumn("given", F.lit(False)))
    return dom.parse_pages(pages, ["page_id", "url", "given"]).select("page_id", "given", p["type"].alias("type"), p["selector"].alias("selector"), p["param"].alias("param"))


@query(
    "SELECT page_id, page_id % 4 + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS iframes, page_id % 3 + page_id % 2 AS lazy_images, page_id % 5 = 0 AS captcha, page_id % 3 = 1 AS cookie_wall, page_id % 7 = 0 AS cloudflare, "
    "page_id % 3 AS login_links, CASE WHEN page_id % 6 = 3 THEN 1 ELSE 0 END AS auth_blocks, page_id % 6 = 2 AS auth_text, CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS blurred, CASE WHEN page_id % 6 = 1 THEN 1 ELSE 0 END AS overlays, "
    "CASE page_id % 4 WHEN 1 THEN 'angular' WHEN 2 THEN 'vue' ELSE 'unknown' END AS framework, page_id % 2 = 1 AS aria, page_id % 3 = 2 AS roles, "
    "CASE WHEN page_id % 5 = 1 THEN '/static/DataDome.js' ELSE '' END AS scripts, page_id % 3 AS honeypots FROM pages"
)
def dom_signals(t):
    n = F.col("nodes")
    bot, sign, safe, why = dom.anti_bot(n), dom.signin(n), dom.accessibility(n), dom.defence(n)
    long = lambda c, name: c.cast("long").alias(name)
    return dom.parse_pages(flavoured(t)).select(
        "page_id", long(dom.iframes(n)["count"], "iframes"), long(dom.lazy_images(n), "lazy_images"), bot["captcha"].alias("captcha"), bot["cookie_wall"].alias("cookie_wall"), bot["cloudflare"].alias("cloudflare"),
        long(sign["login_links"], "login_links"), long(sign["auth_blocks"], "auth_blocks"), sign["auth_text"].alias("auth_text"), long(sign["blurred"], "blurred"), long(sign["overlays"], "overlays"),
        dom.framework(n).alias("framework"), safe["has_aria_labels"].alias("aria"), safe["has_roles"].alias("roles"), joined(why["scripts"]).alias("scripts"), long(why["honeypots"], "honeypots"),
    )


RECON = (
    "(SELECT page_id, page_id % 9 < 5 OR page_id % 7 = 0 AS blocked, page_id % 5 = 0 AS captcha, page_id % 7 = 0 AS cf, "
    "CASE WHEN page_id % 5 = 0 THEN 50 ELSE 0 END + CASE WHEN page_id % 7 = 0 THEN 40 ELSE 0 END + CASE WHEN page_id % 4 IN (1, 2) THEN 20 ELSE 0 END + CASE WHEN page_id % 2 = 1 THEN 15 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 15 ELSE 0 END AS c, "
    "CASE WHEN page_id % 10 = 0 THEN 50 ELSE 0 END + CASE WHEN page_id % 5 = 1 THEN 30 ELSE 0 END + CASE WHEN page_id % 3 > 0 THEN 20 ELSE 0 END + CASE WHEN page_id % 13 = 0 THEN 30 ELSE 0 END AS h, "
    "CASE WHEN page_id % 3 > 0 THEN 20 ELSE 0 END + CASE page_id % 6 WHEN 0 THEN 25 WHEN 1 THEN 35 WHEN 2 THEN 40 WHEN 3 THEN 30 ELSE 0 END + CASE WHEN page_id % 11 = 0 THEN 30 ELSE 0 END AS s FROM pages)"
)
RECON_REASONS = (
    "concat_ws('; ', CASE WHEN captcha THEN 'CAPTCHA detected' END, CASE WHEN cf THEN 'Cloudflare detected' END, CASE WHEN page_id % 4 IN (1, 2) THEN 'SPA Framework detected' END, CASE WHEN page_id % 2 = 1 THEN 'High DOM mutation rate' END, CASE WHEN page_id % 3 = 0 THEN 'Infinite scroll / Lazy loading' END)",
    "concat_ws('; ', CASE WHEN page_id % 10 = 0 THEN 'Bot Cookies: _abck, px3' END, CASE WHEN page_id % 5 = 1 THEN 'Bot Defense Scripts detected' END, CASE WHEN page_id % 3 > 0 THEN 'Honeypots detected (' || page_id % 3 || ')' END, CASE WHEN page_id % 13 = 0 THEN 'Challenge/Verification requests detected' END)",
    "CASE WHEN s >= 40 THEN concat_ws('; ', CASE WHEN page_id % 3 > 0 THEN 'Login buttons detected (' || page_id % 3 || ')' END, CASE page_id % 6 WHEN 3 THEN 'Auth-required content blocks found' WHEN 2 THEN 'Authentication prompts in text' WHEN 0 THEN 'Blurred/restricted content' WHEN 1 THEN 'Authentication overlays' END, "
    "CASE WHEN page_id % 11 = 0 THEN 'Known auth-heavy platform' END) ELSE '' END",
)


@query(
    f"WITH r AS (SELECT *, greatest(h, CASE WHEN s >= 40 THEN s ELSE 0 END) AS hh, {RECON_REASONS[0]} AS rc, {RECON_REASONS[1]} AS rh, {RECON_REASONS[2]} AS rs FROM {RECON}) "
    "SELECT page_id, CASE WHEN hh >= 40 THEN greatest(c, hh) ELSE c + hh END AS complexity, hh AS hostility, hh >= 40 OR c >= 40 AS guided, "
    "CASE WHEN captcha OR cf OR (page_id % 2 = 0 AND page_id % 3 = 0) THEN 'headed' ELSE 'headless' END AS browser_mode, CASE WHEN blocked THEN 'solve' ELSE 'analysis' END AS route, "
    "concat_ws('; ', CASE WHEN hh >= 40 THEN 'Hostile Bot Defense Detected' ELSE nullif(rc, '') END, nullif(rh, ''), nullif(rs, ''), CASE WHEN hh >= 40 THEN nullif(rc, '') END) AS reasons FROM r"
)
def page_recon(t):
    k, pages = F.col("page_id"), flavoured(t)
    kind = F.when(k % 2 == 0, "Application/JSON").otherwise("text/html")
    url = F.when(k % 13 == 0, F.when(k % 2 == 0, "https://x.example/Challenge/1").otherwise("https://x.example/api/VERIFY")).otherwise("https://x.example/")
    requests = pages.select("page_id", url.alias("url"), kind.alias("content_type"), F.when(k % 3 == 0, "WebSocket").alias("upgrade"), F.lit(1).cast("long").alias("size"))
    cookies = F.when(k % 10 == 0, F.array(F.lit("PX3"), F.lit("_ABCK"), F.lit("other"))).otherwise(F.array(F.lit("sid")))
    behaviour = pages.select("page_id", cookies.alias("cookies"), (k % 2 * 0.6).cast("double").alias("mutation_rate"), (k % 3 == 0).alias("grows"), (k % 2 == 0).alias("shadow_dom"))
    out = recon.recon(pages, requests, behaviour)
    return out.select("page_id", "scores.complexity", "scores.hostility", "scores.guided", "browser_mode", "route", joined("scores.reasons").alias("reasons"))


@query("SELECT page_id, 'div.ad' AS css, len(regexp_extract_all(html, '<div class=\"ad\">')) AS found, trim(regexp_extract(html, '<div class=\"ad\">([^<]*)', 1)) AS first_text FROM pages")
def select_ads(t):
    found = dom.select_nodes(dom.parse_pages(t("pages")), "body > div.ad")
    first = F.trim(F.get(F.transform("found", lambda n: text_of(F.col("nodes"), n)), F.lit(0)))
    return found.select("page_id", F.lit("div.ad").alias("css"), F.size("found").cast("long").alias("found"), first.alias("first_text"))


# Listings made of parts: sections, extraction, round trip


def listings(t, size: int = 20) -> DataFrame:
    """Pages of up to `size` parts each, as cards, with white space between tags as captures have it."""
    card = F.concat(
        F.lit('<div class="card">\n\t\t<h2 class="name">'), "p_name", F.lit('</h2>\r\n\t\t<span class="brand">'), "p_brand", F.lit('</span>\n\n<span class="price">'), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        F.lit('</span>\t<a class="more" href="/parts/'), F.col("p_partkey").cast("string"), F.lit('">View</a>\n</div>\n\t'),
    )
    page = F.floor(F.col("p_partkey") / size).cast("long")
    cards = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "")
    out = t("part").groupBy(page.alias("page_id")).agg(F.concat(F.lit("<html><body>\n"), cards, F.lit("</body></html>")).alias("html"))
    out = out.withColumn("url", F.concat(F.lit("https://parts.example.com/?page="), F.col("page_id").cast("string")))
    # A page is little data but much work: keep as many partitions as there are cores for it.
    return out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


CARD = "SELECT p_partkey // {0} AS page_id, row_number() OVER (PARTITION BY p_partkey // {0} ORDER BY p_partkey) AS j, p_name, p_brand, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part"
PARTS_OF_CARD = "(VALUES (1, 'h2', 1), (2, 'span', 1), (3, 'span', 2), (4, 'a', 1)) AS v(i, tag, nth)"


@query(
    f"WITH c AS ({CARD.format(20)}), r AS (SELECT DISTINCT page_id FROM c) SELECT page_id, 0 AS node_id, 'html:nth-of-type(1)' AS css FROM r UNION ALL SELECT page_id, 1, 'html:nth-of-type(1) > body:nth-of-type(1)' FROM r "
    "UNION ALL SELECT page_id, 5 * j - 3, 'html:nth-of-type(1) > body:nth-of-type(1) > div:nth-of-type(' || j || ')' FROM c "
    f"UNION ALL SELECT page_id, 5 * j - 3 + i, 'html:nth-of-type(1) > body:nth-of-type(1) > div:nth-of-type(' || j || ') > ' || tag || ':nth-of-type(' || nth || ')' FROM c, {PARTS_OF_CARD}"
)
def stable_selectors(t):
    return dom.stable_selector(dom.parse_pages(listings(t))).select("page_id", F.col("node_id").cast("long").alias("node_id"), "css")


@query(
    f"WITH c AS ({CARD.format(600)}), r AS (SELECT page_id, count(*) AS n FROM c GROUP BY 1) SELECT page_id, NULL AS parent_id, 0 AS node_id, 'html' AS tag, NULL AS text FROM r UNION ALL SELECT page_id, 0, 1, 'body', NULL FROM r "
    "UNION ALL SELECT page_id, 1, 5 * j - 3, 'div', NULL FROM c WHERE j <= 500 "
    f"UNION ALL SELECT page_id, 5 * j - 3, 5 * j - 3 + i, tag, CASE i WHEN 1 THEN trim(substr(p_name, 1, 50)) WHEN 2 THEN p_brand WHEN 3 THEN price ELSE 'View' END FROM c, {PARTS_OF_CARD} WHERE j <= 500 "
    "UNION ALL SELECT page_id, 1, NULL, '#more', '... ' || (n - 500) || ' more items ...' FROM r WHERE n > 500"
)
def tree_export(t):
    out = dom.tree_export(dom.parse_pages(listings(t, 600)))
    return out.withColumns({"parent_id": F.col("parent_id").cast("long"), "node_id": F.col("node_id").cast("long")})


@query("SELECT p_partkey // 20 AS page_id, 2 * count(*) AS spans, sum(length(p_brand) + length(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR))) AS chars FROM part GROUP BY 1")
def subtree_words(t):
    found = joins.inside(dom.parse_pages(listings(t)), "body > div.card", "span")
    return found.groupBy("page_id").agg(F.count("*").alias("spans"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_partkey // 20 AS page_id, 'repeating_list' AS type, 'div.card' AS selector, count(*) AS count, round(4 * sqrt(count(*)), 6) AS score, 'h2.name; span.brand; span.price; a.more' AS fields FROM part GROUP BY 1 HAVING count(*) > 2")
def listing_sections(t):
    found = dom.sections(dom.parse_pages(listings(t))).filter("rank = 1")
    return found.select("page_id", "type", "selector", "count", F.round("score", 6).alias("score"), joined(F.transform("fields", lambda f: f["css"])).alias("fields"))


@query(
    "WITH c AS (SELECT page_id, page_id % 4 + 3 AS n FROM pages), s AS ("
    "SELECT page_id, 'div.c' AS selector, n, 'b=first; i=x y; div.c=tail text; a=/l' AS fields, 4 AS k, 0 AS o FROM c UNION ALL "
    "SELECT page_id, 'tr.r', n + 1, 'td=cell; td.k=key', 2, 1 FROM c) "
    "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k * sqrt(n) DESC, o) AS INTEGER) AS rank, 'repeating_list' AS type, selector, n AS count, round(k * sqrt(n), 6) AS score, fields FROM s"
)
def mixed_sections(t):
    """Cards whose texts stand between their elements, and table rows; links without text and hidden scripts beside them."""
    k = F.col("page_id")
    card = "<div class='c'><b>first</b> <i>x y</i> tail text<script>var a=1</script><a href='/l'></a><i>again</i></div>"
    row = "<tr class='r'><td>cell</td><td class='k'>key</td></tr>"
    html = F.concat(F.lit("<html><body>"), times(card, k % 4 + 3), F.lit("<table>"), times(row, k % 4 + 4), F.lit("</table><p>"), times("<br>", k % 3), F.lit("</p></body></html>"))
    found = dom.sections(dom.parse_pages(t("pages").select("page_id", "url", html.alias("html"))))
    shown = joined(F.transform("fields", lambda f: F.concat(f["css"], F.lit("="), f["sample"])))
    return found.select("page_id", "rank", "type", "selector", "count", F.round("score", 6).alias("score"), shown.alias("fields"))


@query(
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN '#n' WHEN 1 THEN '.pg' WHEN 2 THEN 'button:contains(''Next'')' WHEN 3 THEN '.x.nextish' END AS selector FROM pages"
)
def next_buttons(t):
    """Texts split over elements, with blanks around them; what only reads as next without its blanks is none."""
    k = F.col("page_id")
    html = F.when(k % 6 == 0, '<a href="/">Home</a><a id="n">\n Next <span>page</span></a>').when(k % 6 == 1, '<a class="pg"><b> \u00bb</b>\n</a>').when(k % 6 == 2, "<a>next page x</a><button> Ne<i>xt</i> </button>")
    html = html.when(k % 6 == 3, '<a>Next page</a><a class="x nextish">more</a>').when(k % 6 == 4, '<a id="n">Next<span>page</span></a>').otherwise('<p id="n">next</p><a>Ne xt</a>')
    found = dom.pagination(F.col("nodes"), F.lit("https://x.example/"))
    return dom.parse_pages(t("pages").select("page_id", "url", html.alias("html"))).select("page_id", found["selector"].alias("selector"))


@query("SELECT page_id, page_id % 8 + 1 AS count, left(url || repeat('x', page_id % 90), 100) AS first_source, least(page_id % 8, 4) + 1 AS sources FROM pages")
def iframe_sources(t):
    """The first five sources, cut at 100 characters; frames without one count, but have none."""
    k = F.col("page_id")
    source = F.concat("url", times("x", k % 90))
    html = F.concat(F.lit("<iframe></iframe><iframe src=''></iframe>"), F.lit("<p><iframe src='"), source, F.lit("'></iframe>"), times("<iframe src='/f'></iframe>", k % 8), F.lit("</p>"))
    found = dom.iframes(F.col("nodes"))
    parsed = dom.parse_pages(t("pages").select("page_id", "url", html.alias("html")))
    return parsed.select("page_id", (found["count"] - 2).cast("long").alias("count"), found["sources"][0].alias("first_source"), F.size(found["sources"]).cast("long").alias("sources"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'The title' ELSE 'text ' || page_id END AS text, '/s' AS image, '/h' AS link, CASE WHEN page_id % 3 = 0 THEN '' END AS empty FROM pages")
def titled_values(t):
    """A title attribute comes before the text, an empty one too."""
    k = F.col("page_id")
    title = F.when(k % 3 == 0, " title='The title'").otherwise("")
    html = F.concat(F.lit("<h2"), title, F.lit(">text "), k.cast("string"), F.lit("</h2><img title='t' src='/s'><a title='t' href='/h'>x</a>"), F.when(k % 3 == 0, "<i title=''>y</i>").otherwise(""))
    body = F.concat(F.lit("<div class='item'>"), html, F.lit("</div>"))
    fields = {"text": ("h2", "text"), "image": ("img", "image"), "link": ("a", "link"), "empty": ("i", "text")}
    return extract.records(dom.parse_pages(t("pages").select("page_id", "url", body.alias("html"))), "div.item", fields).drop("item_no")


@query("SELECT p_partkey // 20 AS page_id, 'DIV' AS tag, 'card' AS classes, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 5")
def best_units(t):
    out = dom.best_unit(dom.parse_pages(listings(t)))
    return out.select("page_id", "tag", joined("classes").alias("classes"), "count")


FIELDS = {"name": ("h2.name", "text"), "brand": ("span.brand", "text"), "price": ("span.price", "text"), "link": ("a.more", "link")}
PARTS = "p_partkey // 20 AS page_id, p_name AS name, p_brand AS brand, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, '/parts/' || p_partkey AS link"


@query(f"SELECT {PARTS}, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS item_no FROM part")
def listing_extract(t):
    return extract.records(dom.parse_pages(listings(t)), "div.card", FIELDS)


@query(f"SELECT {PARTS} FROM part")
def listing_collect(t):
    return recon.collect(dom.parse_pages(listings(t)), "body > div.card", FIELDS).drop("item_no")


@query("SELECT p_partkey // 20 AS page_id, min_by(p_name, p_partkey) AS name FROM part GROUP BY 1")
def listing_preview(t):
    return extract.preview(extract.records(dom.parse_pages(listings(t)), "div.card", {"name": FIELDS["name"]})).select("page_id", "name")


@query("SELECT p_partkey // 20 AS page_id, CASE WHEN (p_partkey // 20) % 2 = 0 THEN 'even' ELSE 'odd' END AS site, CASE WHEN (p_partkey // 20) % 2 = 0 THEN p_name ELSE p_brand END AS value FROM part")
def listing_templates(t):
    site = F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd")
    pages = listings(t).withColumn("site", site)
    field = lambda name: F.array(template_node("cards", "list", "div.card"), template_node("value", "field", FIELDS[name][0]))
    templates = pages.select("site").distinct().withColumn("nodes", F.when(F.col("site") == "even", field("name")).otherwise(field("brand")))
    return extract.template_records(extract.from_templates(pages, templates)).select("page_id", "site", F.col("fields")["value"].alias("value"))


def template_node(name: str, kind: str, /, *chain: str | Column, **metadata: str) -> Column:
    pairs = [F.lit(x) for kv in metadata.items() for x in kv]
    about = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.array(*(c if isinstance(c, Column) else F.lit(c) for c in chain)).alias("selector_chain"), about.alias("metadata"))


def site_templates(t) -> tuple[DataFrame, DataFrame]:
    """Listing pages with a pager, each a site of its own, and a template for each site.

    Every fifth template's list goes by a chain of two selectors, every seventh has a selector that is not supported.
    """
    k = F.col("page_id")
    pager = F.concat(F.lit('<div class="pager"><a class="prev" href="/0">Back</a><p><a class="next" href="/'), (k + 1).cast("string"), F.lit('">Next</a></p></div></body>'))
    pages = listings(t).withColumn("html", F.replace("html", F.lit("</body>"), pager)).withColumn("site", F.concat(F.lit("site"), k.cast("string")))
    chain = F.when(k % 5 == 0, F.array(F.lit("html > body"), F.lit("div.card"))).when(k % 7 == 0, F.array(F.lit("div:hover"))).otherwise(F.array(F.lit("body > .card, body > .none")))
    cards = F.struct(F.lit("cards").alias("name"), F.lit("list").alias("type"), chain.alias("selector_chain"), F.create_map().cast("map<string,string>").alias("metadata"))
    fields = [template_node("name", "field", "h2"), template_node("price", "field", "span:nth-of-type(2)"), template_node("key", "field", 'a[href*="/parts/"]', kind="link"), template_node("css", "field", "span.brand", attribute="class"), template_node("none", "field", "h2", "a")]
    nodes = F.array(cards, *fields, template_node("next", "pagination", "div.pager", "p > a.next"))
    return pages, pages.select("site", nodes.cast(extract.TEMPLATE).alias("nodes"))


@query(
    "SELECT p_partkey // 20 AS page_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS item_no, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, '/parts/' || p_partkey AS key, 'brand' AS css, NULL AS none "
    "FROM part WHERE NOT ((p_partkey // 20) % 7 = 0 AND (p_partkey // 20) % 5 <> 0)"
)
def template_records(t):
    found = extract.template_records(extract.from_templates(*site_templates(t)))
    return found.select("page_id", "item_no", *(F.col("fields")[f].alias(f) for f in ("name", "price", "key", "css", "none")))


@query(
    "SELECT p_partkey // 20 AS page_id, CASE WHEN bad THEN 0 ELSE count(*) END AS items, CASE WHEN NOT bad THEN '/' || (p_partkey // 20 + 1) END AS next, CASE WHEN bad THEN 'selector not supported: div:hover' END AS error "
    "FROM (SELECT *, (p_partkey // 20) % 7 = 0 AND (p_partkey // 20) % 5 <> 0 AS bad FROM part) GROUP BY 1, bad"
)
def template_pages(t):
    return extract.from_templates(*site_templates(t)).select("page_id", F.size("items").cast("long").alias("items"), "next", "error")


def _cards(nodes: list[dict]):
    return [n for n in nodes if n["tag"] == "a"]


def _card(node: dict):
    key = int(dict(node["attrs"])["href"].rsplit("/", 1)[1])
    if key % 5 == 0:
        raise ValueError(f"part {key}")
    return None if key % 5 == 1 else "text" if key % 5 == 2 else {"key": key}


@query(
    "SELECT p_partkey // 20 AS page_id, CASE WHEN p_partkey % 5 > 2 THEN CAST(p_partkey AS VARCHAR) END AS key, CASE p_partkey % 5 WHEN 0 THEN 'ValueError: part ' || p_partkey WHEN 2 THEN 'TypeError: str is no dict' END AS error FROM part WHERE p_partkey % 5 <> 1"
)
def listing_plugin(t):
    good, bad = filters.split_failures(extract.extract_with(listings(t), _cards, _card, ["key"]))
    good = filters.drop_empty(good, ["key"]).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(bad).select("page_id", "key", "error")


@query(SQL["listing_plugin"])
def listing_plugin_sql(t):
    pages = listings(t)
    spark = pages.sparkSession
    extract.register_plugin(spark, "parts_of_page", _cards, _card, ["key"])
    return spark.sql("SELECT page_id, r.key, r.error FROM {pages}, LATERAL parts_of_page(html) r WHERE r.key IS NOT NULL OR r.error IS NOT NULL", pages=pages)


# Documents


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[a-zA-Z0-9]{32,}', '[REDACTED_API_KEY]', 'g'), 'password=[\\p{L}\\p{N}_!@#$%^&*()]+', '[REDACTED_PASSWORD]', 'g'), "
    "'[\\p{L}\\p{N}_.-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+', '[REDACTED_EMAIL]', 'g'), 'Bearer [a-zA-Z0-9._-]+', '[REDACTED_AUTH_TOKEN]', 'g') AS text FROM documents"
)
def redact_documents(t):
    return t("documents").select("doc_id", fn.redact_text(F.col("text")).alias("text"))


TRIMMED = "regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"


@query(f"SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lower({TRIMMED}) || '|' || coalesce(lower(lang), 'none') ORDER BY doc_id) = 1")
def content_dedup(t):
    return aggregates.dedup_records(t("documents"), "source", ["doc_id"], ["text", "lang"]).select("doc_id", "source", "lang")


@query(
    "SELECT 'quality' AS column_name, count(*) FILTER (WHERE quality IS NULL OR quality = 0) AS missing, count(*) AS total, count(*) FILTER (WHERE quality IS NULL OR quality = 0) / count(*) AS ratio, count(*) FILTER (WHERE quality IS NULL OR quality = 0) / count(*) > 0.8 AS flagged FROM labels "
    "UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL OR toxic = 0), count(*), count(*) FILTER (WHERE toxic IS NULL OR toxic = 0) / count(*), count(*) FILTER (WHERE toxic IS NULL OR toxic = 0) / count(*) > 0.8 FROM labels"
)
def missing_columns(t):
    return aggregates.missing_ratio(t("labels"), ["quality", "toxic"])


@query(
    "SELECT source, CASE WHEN n > 0.5 OR s > 0.5 THEN 'fix_columns' ELSE 'pass' END AS verdict, concat_ws('; ', CASE WHEN n > 0.5 THEN 'long' END, CASE WHEN s > 0.5 THEN 'tag' END) AS bad_columns FROM "
    "(SELECT source, avg(CASE WHEN n_chars < 1500 THEN 1 ELSE 0 END) AS n, avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS s FROM documents GROUP BY source)"
)
def quality_gate(t):
    rows = t("documents").select("source", (F.col("n_chars") >= 1500).alias("long"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("tag"))
    out = aggregates.quality_verdict(rows, "source", ["long", "tag"])
    return out.select("source", "verdict", joined("bad_columns").alias("bad_columns"))


MESSAGES = ["TimeoutError: 30s", "IndentationError at 4", "waiting for selector h1", "Connection refused", "no idea", "Element not found: TIMEOUTERROR"]
CLASSES = ["timeout_error", "syntax_error", "selector_error", "network_error", "general_error", "timeout_error"]


@query(
    "SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END AS error_class, doc_id % 6 IN (0, 1, 2, 5) AS recoverable FROM documents"
)
def error_classes(t):
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = filters.error_class(message)
    return t("documents").select("doc_id", kind.alias("error_class"), kind.isin(filters.RECOVERABLE).alias("recoverable"))


# Conversations


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n FROM conversations")
def json_from_text(t):
    body = F.to_json(F.struct("role", F.length("text").alias("n")))
    content = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("The data: "), body, F.lit(" Hope this helps!")))
    found = fn.parse_json(content)
    return t("conversations").select("conv_id", "turn", F.try_variant_get(found, "$.role", "string").alias("role"), F.try_variant_get(found, "$.n", "long").alias("n"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'import os' || chr(10) || 'x = ' || conv_id WHEN 1 THEN 'def f(): pass' ELSE 'nothing' END AS code FROM conversations")
def code_from_text(t):
    three = F.concat(F.lit("short:\n```python\npass\n```\nlong:\n```\nimport os\nx = "), F.col("conv_id").cast("string"), F.lit("\n```"))
    content = F.when(F.col("turn") % 3 == 0, three).when(F.col("turn") % 3 == 1, "Sure thing.\ndef f(): pass").otherwise("nothing")
    return t("conversations").select("conv_id", "turn", fn.code_text(content).alias("code"))


MODELS = ["gpt-4o", "gpt-4o-mini", "claude-3-opus", "own-model"]


@query(
    "SELECT model, sum(i) AS input_tokens, sum(o) AS output_tokens, count(*) AS calls, round(sum(i) / 1e6 * CASE model WHEN 'gpt-4o' THEN 5 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'claude-3-opus' THEN 15 ELSE 0 END + "
    "sum(o) / 1e6 * CASE model WHEN 'gpt-4o' THEN 15 WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'claude-3-opus' THEN 75 ELSE 0 END, 8) AS cost FROM (SELECT ['gpt-4o', 'gpt-4o-mini', 'claude-3-opus', 'own-model'][conv_id % 4 + 1] AS model, "
    "CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS i, CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS o FROM conversations) GROUP BY model"
)
def token_costs(t):
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 4 + 1).cast("int"))
    user, n = F.col("role") == "user", F.length("text").cast("long")
    calls = t("conversations").select(model.alias("model"), F.when(user, n).otherwise(0).alias("input_tokens"), F.when(user, 0).otherwise(n).alias("output_tokens"))
    return joins.token_cost(aggregates.usage_totals(calls)).withColumn("cost", F.round("cost", 8))


# Events


@query("SELECT user_id, time_bucket(INTERVAL '4 seconds', ts, TIMESTAMP '1970-01-01') AS start, sum(event_id % 7) / 4 AS rate FROM events GROUP BY 1, 2")
def mutation_rate(t):
    return streams.mutation_rate(t("events").select("user_id", "ts", (F.col("event_id") % 7).alias("n")), key="user_id")


@query(
    "WITH p AS (SELECT event_id // 60 AS page_id, (event_id % 60) * 100 AS ms, least(event_id % 60, (event_id // 60) % 70) AS n FROM events), "
    "f AS (SELECT page_id, ms - min(ms) OVER (PARTITION BY page_id) AS ms, n FROM p), l AS (SELECT *, lag(n) OVER (PARTITION BY page_id ORDER BY ms) AS b FROM f WHERE ms <= 5000), "
    "i AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> n THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ms) AS g FROM l), a AS (SELECT *, ms - min(ms) OVER (PARTITION BY page_id, g) AS age FROM i) "
    "SELECT page_id, coalesce(bool_or(age >= 800), false) AS reached, coalesce(arg_min(n, ms) FILTER (WHERE age >= 800), arg_max(n, ms)) AS stable_node_count, coalesce(min(ms) FILTER (WHERE age >= 800), 5000) AS stability_reached_ms FROM a GROUP BY page_id"
)
def dom_stability(t):
    k = F.col("event_id")
    page, i = F.floor(k / 60).cast("long"), k % 60
    return windows.stability(t("events").select(page.alias("page_id"), F.timestamp_millis(i * 100).alias("ts"), F.least(i, page % 70).alias("node_count")))


STATES = {"purchase": "DONE", "error": "FAILED"}


@query(
    "SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' ELSE 'RECON' END AS final_state, round(epoch(max(ts)) - epoch(min(ts)), 2) AS duration_seconds, "
    "arg_max(event_type, (ts, event_id)) = 'purchase' AS success FROM events GROUP BY user_id"
)
def wide_events(t):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "DONE").when(kind == "error", "FAILED").otherwise("RECON")
    rows = t("events").select("user_id", "ts", "event_id", state.alias("state"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("error"))
    return aggregates.wide_events(rows, "user_id", ["event_id"]).select("user_id", "final_state", "duration_seconds", "success")


@query(
    "SELECT user_id AS page_id, count(*) AS request_count, count(*) FILTER (WHERE event_id % 2 = 0) AS json_responses, count(*) FILTER (WHERE event_id % 10 = 0) AS realtime, sum(CASE WHEN event_id % 2 = 0 THEN length(event_type) END) AS json_bytes, "
    "string_agg(DISTINCT CASE WHEN event_id % 3 = 0 THEN 'https://x.example/api/' || event_type END, '; ' ORDER BY CASE WHEN event_id % 3 = 0 THEN 'https://x.example/api/' || event_type END) AS api_endpoints FROM events GROUP BY user_id"
)
def network_activity(t):
    k = F.col("event_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://x.example/api/"), "event_type")).otherwise("https://x.example/page")
    rows = t("events").select(
        F.col("user_id").alias("page_id"), url.alias("url"), F.when(k % 2 == 0, "Application/JSON; charset=utf-8").otherwise("text/html").alias("content_type"),
        F.when(k % 10 == 0, "WebSocket").alias("upgrade"), F.length("event_type").cast("long").alias("size"),
    )
    return aggregates.network_activity(rows).drop("has_challenge").withColumn("api_endpoints", joined("api_endpoints"))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) "
    "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS \"end\", count(*) AS events FROM g GROUP BY user_id, s"
)
def event_sessions(t):
    return streams.sessions(t("events"), "user_id", gap="12 hours")


@query("SELECT user_id, max(CASE WHEN event_id % 2 = 0 THEN event_id % 97 END) AS before, max(CASE WHEN event_id % 2 = 1 THEN event_id % 101 END) AS after, coalesce(max(CASE WHEN event_id % 2 = 1 THEN event_id % 101 END) > max(CASE WHEN event_id % 2 = 0 THEN event_id % 97 END), false) AS grew FROM events GROUP BY user_id")
def scroll_dependency(t):
    k = F.col("event_id")
    rows = t("events").select("user_id", F.when(k % 2 == 0, "before").otherwise("after").alias("phase"), F.when(k % 2 == 0, k % 97).otherwise(k % 101).alias("node_count"))
    return aggregates.scroll_dependency(rows, "user_id").select("user_id", "before", "after", "grew")


@query("SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 50 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 40 ELSE 0 END) + (CASE WHEN event_id % 5 = 0 THEN 20 ELSE 0 END) + (CASE WHEN value > 0.5 THEN 15 ELSE 0 END) AS score, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 OR (event_id % 150 < 100 AND event_id % 20 > 10) THEN 'headed' ELSE 'headless' END AS mode FROM events")
def complexity_scores(t):
    k = F.col("event_id")
    score = scoring.complexity(k % 2 == 0, k % 3 == 0, F.when(k % 5 == 0, "react").otherwise("unknown"), F.col("value"), F.lit(False))
    mode = scoring.browser_mode(k % 2 == 0, k % 3 == 0, k % 150, k % 20, F.lit(False), F.lit(False))
    return t("events").select("event_id", score["score"].alias("score"), mode.alias("mode"))


@query(
    "WITH s AS (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 50 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 20 ELSE 0 END) + (CASE WHEN event_id % 7 = 0 THEN 30 ELSE 0 END) AS h, CASE WHEN event_id % 5 = 0 THEN 50 ELSE 0 END AS c FROM events) "
    "SELECT event_id, h AS hostility, CASE WHEN h >= 40 THEN greatest(c, h) ELSE c + h END AS complexity, h >= 40 OR c >= 40 AS guided FROM s"
)
def hostility_scores(t):
    k = F.col("event_id")
    none = F.array().cast("array<string>")
    cookies = joins.known_cookies(F.when(k % 2 == 0, F.array(F.lit("_ABCK"), F.lit("other"))).otherwise(F.array(F.lit("incap_ses_1"))))
    urls = F.when(k % 7 == 0, F.array(F.lit("https://x.example/verify"))).otherwise(none)
    h = scoring.hostility(cookies, none, F.when(k % 3 == 0, 1).otherwise(0), urls)
    c = scoring.complexity(k % 5 == 0, F.lit(False), F.lit("unknown"), F.lit(0.0), F.lit(False))
    quiet = F.struct(F.lit(0).alias("score"), F.lit(False).alias("detected"), none.alias("reasons"))
    m = scoring.merged(c, h, quiet)
    return t("events").select("event_id", m["hostility"].alias("hostility"), m["complexity"].alias("complexity"), m["guided"].alias("guided"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND value >= 0.5")
def confidence_gate(t):
    possible = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.lit(True))
    return t("events").filter(filters.confident(possible, F.col("value"))).select("event_id")


# Orders and lines at volume


@query(
    "WITH w AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, min(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM orders) "
    "SELECT o_custkey, o_orderkey FROM w WHERE n <= 5 AND coalesce(g, 1) = 1"
)
def paging_walk(t):
    rows = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").alias("has_next"))
    return extract.paging_walk(rows, "o_custkey", "o_orderkey", "has_next", extract.max_pages(F.lit("limit_5"))).drop("has_next")


@query("SELECT o_orderpriority, count(*) AS rows_extracted, least(count(*), 10) AS shown, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def order_report(t):
    out = aggregates.report(t("orders"), "o_orderpriority", ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    return out.select("o_orderpriority", "rows_extracted", F.size("sample_data").cast("long").alias("shown"), F.col("sample_data")[0]["o_orderkey"].alias("first_key"))


@query("SELECT o_orderpriority, count(*) AS expected, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS missing, count(*) FILTER (WHERE o_orderkey % 11 = 0) / count(*) AS rate, count(*) FILTER (WHERE o_orderkey % 11 = 0) / count(*) < 0.1 AS ok FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def drift(t):
    orders = t("orders")
    return joins.drift(orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderkey % 11 <> 0"), "o_orderpriority", ["o_orderkey"])


@query("SELECT l_shipmode_key, l_returnflag, l_linestatus, l_quantity, l_discount FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS l_shipmode_key, l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_shipmode_key, l_returnflag, l_linestatus, l_quantity, l_discount ORDER BY l_orderkey, l_linenumber) = 1")
def line_dedup(t):
    rows = t("lineitem").withColumnRenamed("l_suppkey", "l_shipmode_key")
    fields = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
    return aggregates.dedup_records(rows, "l_shipmode_key", ["l_orderkey", "l_linenumber"], fields).select("l_shipmode_key", *fields)


@query("SELECT CASE WHEN c_custkey <> 0 THEN CAST(c_custkey AS VARCHAR) END AS c_custkey, CASE WHEN length(c_name) > 40 THEN substr(c_name, 1, 37) || '...' ELSE nullif(c_name, '') END AS c_name, c_mktsegment FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)")
def customer_preview(t):
    return windows.data_preview(t("customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS project_id, c_name AS url, c_acctbal AS updated_at FROM customer")
def recent_projects(t):
    rows = t("customer").select(F.col("c_custkey").cast("string").alias("project_id"), F.col("c_name").alias("url"), F.col("c_acctbal").alias("updated_at"))
    return windows.recent_projects(rows)


@query("SELECT s_suppkey AS k, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def append_results(t):
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return windows.append(s, c)


@query("SELECT o.o_orderkey AS project_id, c_name, n_name FROM orders o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def project_context(t):
    orders = t("orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("c_custkey"))
    with_customer = joins.context(orders, t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), key="c_custkey")
    return joins.context(with_customer, t("nation").select("n_nationkey", "n_name"), key="n_nationkey").select("project_id", "c_name", "n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE NULL END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment IS NOT NULL")
def project_fields(t):
    data = F.map_from_arrays(F.array(F.lit("name"), F.lit("segment")), F.array(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.col("c_mktsegment")))
    rows = filters.project_fields(t("customer").select("c_custkey", data.alias("fields")), ["name", "segment"], ["c_custkey"])
    return filters.drop_empty(rows, ["name", "segment"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a; b; c; d; e' END AS chosen FROM customer")
def choose_fields(t):
    field = lambda n, s: F.struct(F.lit(n).alias("name"), F.lit(s).alias("suggested"))
    none, one = F.array(*(field(n, False) for n in "abcdefg")), F.array(field("a", False), field("b", True))
    return t("customer").select("c_custkey", joined(filters.choose_fields(F.when(F.col("c_custkey") % 2 == 0, one).otherwise(none))).alias("chosen"))


@query("SELECT user_id, '[REDACTED]' AS token, event_type AS note FROM events")
def redact_fields(t):
    data = F.create_map(F.lit("Token"), F.lit("abc"), F.lit("note"), F.col("event_type"))
    safe = fn.redact_map(data)
    return t("events").select("user_id", safe["Token"].alias("token"), safe["note"].alias("note"))


@query(
    "SELECT c_custkey, '[REDACTED]' AS secret, CASE WHEN c_custkey % 2 = 0 THEN '[REDACTED_EMAIL] of ' || c_mktsegment ELSE c_name END AS note, '[REDACTED]' AS inner_key, 'Name ' || c_name AS inner_name, "
    "'[REDACTED]' AS item_token, '[REDACTED_PASSWORD]' AS item_text, 'password=1' AS plain_item FROM customer"
)
def redact_structs(t):
    """Nested structs and structs in arrays are redacted, strings in arrays are not."""
    note = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a.b@x.example of "), "c_mktsegment")).otherwise(F.col("c_name"))
    item = F.struct(F.lit("t").alias("token"), F.lit("password=a1!").alias("text"))
    data = F.struct(F.lit("s").alias("Secret"), note.alias("note"), F.struct(F.col("c_name").alias("KEY"), F.concat(F.lit("Name "), "c_name").alias("name")).alias("inner"), F.array(item).alias("items"), F.array(F.lit("password=1")).alias("plain"))
    rows = t("customer").select("c_custkey", data.alias("d"))
    safe = rows.select("c_custkey", fn.redact_struct(F.col("d"), rows.schema["d"].dataType).alias("d"))
    return safe.select(
        "c_custkey", F.col("d.Secret").alias("secret"), "d.note", F.col("d.inner.KEY").alias("inner_key"), F.col("d.inner.name").alias("inner_name"),
        F.col("d.items")[0]["token"].alias("item_token"), F.col("d.items")[0]["text"].alias("item_text"), F.col("d.plain")[0].alias("plain_item"),
    )


@query("SELECT event_id, list_position(['INIT', 'RECON', 'TEST', 'DONE', 'FAILED'], s) IS NOT NULL AS known, CASE s WHEN 'INIT' THEN 1 WHEN 'RECON' THEN 4 WHEN 'TEST' THEN 9 WHEN 'DONE' THEN 13 WHEN 'FAILED' THEN 14 END AS step, s IN ('DONE', 'FAILED') AS final FROM (SELECT event_id, ['INIT', 'RECON', 'TEST', 'DONE', 'FAILED', 'NONE'][event_id % 6 + 1] AS s FROM events)")
def state_steps(t):
    state = F.element_at(F.array(*map(F.lit, ["INIT", "RECON", "TEST", "DONE", "FAILED", "NONE"])), (F.col("event_id") % 6 + 1).cast("int"))
    step = fn.state_order(state)
    return t("events").select("event_id", step.isNotNull().alias("known"), step.cast("long").alias("step"), fn.is_final(state).alias("final"))


@query("SELECT event_id, CASE WHEN value * 100 >= 40 OR event_id % 7 = 0 THEN 'headed' ELSE CASE WHEN event_id % 2 = 0 THEN 'headed' ELSE 'headless' END END AS mode, CASE WHEN event_id % 3 = 0 OR (event_id % 5 = 0 AND event_id % 4 = 0) THEN 'solve' ELSE 'analysis' END AS route FROM events")
def mode_and_route(t):
    k = F.col("event_id")
    mode = scoring.mode_override(F.when(k % 2 == 0, "headed").otherwise("headless"), F.col("value") * 100, k % 7 == 0)
    return t("events").select("event_id", mode.alias("mode"), scoring.route(k % 3 == 0, k % 5 == 0, k % 4 == 0).alias("route"))


@query("SELECT source, count(*) AS records, count(*) - count(DISTINCT lower(" + TRIMMED + ") || '|' || coalesce(lower(lang), 'none')) AS removed FROM documents GROUP BY source")
def removed_records(t):
    return aggregates.removed_counts(t("documents"), "source", ["text", "lang"])


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'no_data' WHEN avg(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) > 0.5 THEN 'fix_columns' ELSE 'pass' END AS verdict FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def data_verdicts(t):
    rows = t("orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("done"))
    return aggregates.quality_verdict(rows, "c_custkey", ["done"], projects=t("customer")).select("c_custkey", "verdict")


@query("SELECT c_custkey, c_name AS url, count(o_orderkey) AS rows_extracted, min(o_orderkey) AS first_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def customer_report(t):
    rows, names = t("orders").withColumnRenamed("o_custkey", "c_custkey"), t("customer").select("c_custkey", F.col("c_name").alias("url"))
    out = aggregates.report(rows, "c_custkey", ["o_orderkey"], ["o_orderkey"], sessions=names)
    return out.select("c_custkey", "url", "rows_extracted", F.get("sample_data", F.lit(0))["o_orderkey"].alias("first_key"))


def requests(t) -> DataFrame:
    """A network log made of the events: every third a call of an API, every second answered in JSON."""
    k = F.col("event_id")
    return t("events").select(
        F.col("user_id").alias("page_id"), "ts", F.concat(F.lit("https://x.example/"), F.when(k % 3 == 0, "API/").otherwise("page/"), k.cast("string")).alias("url"), F.when(k % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.when(k % 5 == 0, "xhr").otherwise("fetch").alias("resource_type"), F.when(k % 2 == 0, "Application/JSON").otherwise("text/html").alias("content_type"), F.when(k % 10 == 0, "WebSocket").alias("upgrade"),
        (k % 500).cast("int").alias("status"), (k % 91).alias("size"),
    )


@query("SELECT user_id AS page_id, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN event_id % 5 = 0 THEN 'xhr' ELSE 'fetch' END AS resource_type, 'https://x.example/API/' || event_id AS url FROM events WHERE event_id % 3 = 0")
def api_requests(t):
    return aggregates.api_requests(requests(t))


@query("SELECT user_id AS page_id, event_id % 500 AS status, event_id % 91 AS size, 'https://x.example/' || CASE WHEN event_id % 3 = 0 THEN 'API/' ELSE 'page/' END || event_id AS url FROM events WHERE event_id % 2 = 0")
def json_responses(t):
    return aggregates.json_responses(requests(t))


@query(
    "SELECT user_id AS page_id, time_bucket(INTERVAL '1 minute', ts) AS start, count(*) AS request_count, count(*) FILTER (WHERE event_id % 3 = 0) AS api_calls, count(*) FILTER (WHERE event_id % 2 = 0) AS json_responses, count(*) FILTER (WHERE event_id % 10 = 0) AS realtime FROM events GROUP BY 1, 2"
)
def network_counters(t):
    return streams.network_counters(requests(t))


@query(
    "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) "
    "SELECT user_id, max_by(CASE event_type WHEN 'purchase' THEN 'DONE' ELSE 'CODEGEN' END, (ts, CASE event_type WHEN 'purchase' THEN 'DONE' ELSE 'CODEGEN' END)) AS final_state, round(epoch(max(ts)) - epoch(min(ts)), 2) AS duration_seconds FROM g GROUP BY user_id, s"
)
def completions(t):
    state = F.when(F.col("event_type") == "purchase", "DONE").otherwise("CODEGEN")
    rows = t("events").select("user_id", "ts", state.alias("state"))
    return streams.completions(rows, "user_id", gap="12 hours").select("user_id", "final_state", "duration_seconds")


# Streams, run to the end of the given tables


def thirds(frame: DataFrame, key: str) -> list[DataFrame]:
    """The rows in three parts of ascending keys."""
    most = frame.agg(F.max(key)).first()[0] or 0
    return [frame.filter((F.col(key) > most * i // 3) if i else F.lit(True)).filter((F.col(key) <= most * (i + 1) // 3) if i < 2 else F.lit(True)) for i in range(3)]


@query(
    "SELECT user_id AS page_id, time_bucket(INTERVAL '1 minute', ts) AS start, count(*) AS request_count, count(*) FILTER (WHERE event_id % 3 = 0) AS api_calls, count(*) FILTER (WHERE event_id % 2 = 0) AS json_responses, count(*) FILTER (WHERE event_id % 10 = 0) AS realtime "
    "FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 minute' FROM events)"
)
def live_network_counters(t):
    """Windows that the watermark has passed, in append mode, hot pages in eight shares."""
    rows = requests(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return t.streamed(rows, lambda s: streams.network_counters(s, salts=8))


@query(
    "SELECT user_id, time_bucket(INTERVAL '4 seconds', ts, TIMESTAMP '1970-01-01') AS start, sum(event_id % 7) / 4 AS rate FROM events GROUP BY 1, 2 "
    "HAVING time_bucket(INTERVAL '4 seconds', ts, TIMESTAMP '1970-01-01') + INTERVAL '4 seconds' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 seconds' FROM events)"
)
def live_mutation_rate(t):
    """Windows that the watermark has passed, in append mode."""
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7).alias("n"))
    return t.streamed(rows, lambda s: streams.mutation_rate(s, key="user_id"))


@query(
    "WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'DONE' ELSE 'CODEGEN' END AS state FROM events), "
    "o AS (SELECT *, lag(ts) OVER w AS before, lag(state) OVER w AS old FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, state)), "
    "g AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL '12 hours' AND old <> 'DONE' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, state ROWS UNBOUNDED PRECEDING) AS s FROM o), "
    "r AS (SELECT user_id, s, max_by(state, (ts, state)) AS final_state, min(ts) AS first, max(ts) AS last FROM g GROUP BY 1, 2), n AS (SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY s) AS later FROM r) "
    "SELECT user_id, final_state, final_state = 'DONE' AS ended, ((epoch_us(last) - epoch_us(first) + 5000) // 10000) / 100 AS duration_seconds FROM n "
    "WHERE final_state = 'DONE' OR later IS NOT NULL OR last + INTERVAL '12 hours' < (SELECT max(ts) - INTERVAL '1 hour' FROM events)"
)
def live_completions(t):
    """Sessions that a final state, a gap or a timer has ended; those still open at the end of the stream are not told."""
    state = F.when(F.col("event_type") == "purchase", "DONE").otherwise("CODEGEN")
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), state.alias("state"))
    store = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    return t.streamed(rows, lambda s: streams.live_completions(s, "user_id", gap="12 hours"), store)


@query(
    "WITH m AS (SELECT max(event_id) AS m FROM events), p AS (SELECT event_id, ts, CASE WHEN event_id <= m // 3 THEN 2 WHEN event_id <= m * 2 // 3 THEN 0 ELSE 1 END AS part FROM events, m), "
    "h AS (SELECT part, max(ts) AS high FROM p GROUP BY 1) SELECT event_id, part AS batch FROM p WHERE ts < (SELECT max(high) FROM h WHERE h.part < p.part) - INTERVAL '2 hours'"
)
def late_events(t):
    """Late rows of a stream whose first third comes last, and the batch each came in."""
    first, second, third = thirds(t("events").select("event_id", "ts"), "event_id")
    path = t.arriving([second, third, first], lambda s, out: streams.side_output(s, out, late="2 hours"))
    return streams.late_rows(t.spark, path).select("event_id", F.col("batch").cast("long").alias("batch"))


@query(SQL["content_dedup"])
def live_content_dedup(t):
    """A stream that stops and starts again twice keeps what the batch keeps."""
    parts = thirds(t("documents").select("doc_id", "source", "lang", "text"), "doc_id")
    path = t.arriving(parts, lambda s, out: streams.dedup_for_good(s, out, "source", ["doc_id"], ["text", "lang"]))
    return streams.first_records(t.spark, path).select("doc_id", "source", "lang")


@query("SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 2 = 0 THEN '[' || event_id || ',null]' END AS steps FROM events")
def recording_steps(t):
    """A recording that is appended to twice and read as a stream: its steps, and the event time."""
    k = F.col("event_id").cast("string")
    data = F.create_map(F.lit("id"), k, F.lit("user_id"), F.col("user_id").cast("string"), F.lit("steps"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), k, F.lit(",null]"))))
    path = scratch(t.spark, "recording")
    for part in (0, 1):
        sinks.append_events(t("events").filter(F.col("event_id") % 2 == part).select(F.col("event_type").alias("type"), data.alias("data")), f"{path}/in")
    live = streams.recording_tail(t.spark, f"{path}/in").filter("ts IS NOT NULL")
    live.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    rows = t.spark.read.schema(live.schema).parquet(f"{path}/out")
    return rows.select(F.col("data")["id"].cast("long").alias("event_id"), "type", F.col("data")["user_id"].alias("user_id"), F.col("data")["steps"].alias("steps"))


# Sources and sinks: what is written is read back


@query("SELECT event_id, 'run' AS name, 'm ' || event_id AS message, CAST(user_id AS VARCHAR) AS user_id, '{\"kind\":\"' || event_type || '\",\"n\":[1,2]}' AS detail, CASE WHEN event_id % 3 = 0 THEN 'inner' END AS kept FROM events")
def log_lines(t):
    """Log lines with fields of their own on the top level, some nested, some in an object named extra, corrupt lines between them."""
    k = F.col("event_id")
    line = F.struct(
        F.lit("2024").alias("asctime"), F.lit("run").alias("name"), F.lit("INFO").alias("levelname"), F.concat(F.lit("m "), k.cast("string")).alias("message"), k.alias("event_id"), "user_id",
        F.struct(F.col("event_type").alias("kind"), F.array(F.lit(1), F.lit(2)).alias("n")).alias("detail"), F.when(k % 3 == 0, F.struct(F.lit("inner").alias("kept"), F.lit("x").alias("event_id"))).alias("extra"),
    )
    text = F.to_json(line)
    path = scratch(t.spark, "log")
    t("events").select(F.explode(F.when(k % 50 == 0, F.array(text, F.lit("{broken"))).otherwise(F.array(text))).alias("value")).write.text(path)
    extra = lambda name: F.col("extra")[name]
    return readers.read_logs(t.spark, path).select(extra("event_id").cast("long").alias("event_id"), "name", "message", extra("user_id").alias("user_id"), extra("detail").alias("detail"), extra("kept").alias("kept"))


@query("SELECT event_id, event_type AS kind, event_id % 4 AS n, CASE WHEN event_id % 4 = 1 THEN 'v' END AS mark FROM events WHERE event_id % 2 = 1")
def recording_baseline(t):
    """The extracted records of a recording; other events and other fields of a line do not disturb."""
    k = F.col("event_id")
    data = F.struct(k.alias("event_id"), F.col("event_type").alias("kind"), (k % 4).alias("n"), F.when(k % 4 == 1, "v").alias("mark"))
    line = F.struct(F.lit("2024-01-01T00:00:00").alias("timestamp"), F.when(k % 2 == 1, "extract").otherwise("click").alias("type"), data.alias("data"), F.lit(1).alias("session"))
    path = scratch(t.spark, "recording")
    t("events").select(F.to_json(line).alias("value")).write.text(path)
    d = F.col("data")
    return readers.baseline(readers.read_recording(t.spark, path)).select(d["event_id"].cast("long").alias("event_id"), d["kind"].alias("kind"), d["n"].cast("long").alias("n"), d["mark"].alias("mark"))


@query(
    "SELECT doc_id // 50 AS file, CASE WHEN (doc_id // 50) % 10 NOT IN (3, 7) THEN doc_id ELSE -1 END AS doc_id, CASE WHEN (doc_id // 50) % 10 NOT IN (3, 7) THEN n_chars END AS n_chars, (doc_id // 50) % 10 IN (3, 7) AS is_default "
    "FROM documents WHERE (doc_id // 50) % 10 NOT IN (3, 7) OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY doc_id // 50) "
    "UNION ALL SELECT DISTINCT -1 - doc_id // 50, -1, NULL, TRUE FROM documents"
)
def json_defaults(t):
    """A JSON file for every 50 documents: some are cut off, some blank, and as many again are asked for that do not exist."""
    docs = t("documents").select(F.floor(F.col("doc_id") / 50).cast("long").alias("file"), "doc_id", "n_chars")
    whole = F.to_json(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))))
    files = docs.groupBy("file").agg(whole.alias("json"))
    text = F.when(F.col("file") % 10 == 3, F.expr("left(json, length(json) - 2)")).when(F.col("file") % 10 == 7, " ").otherwise(F.col("json"))
    path = scratch(t.spark, "json")
    files.select(F.concat(F.lit("f"), F.col("file").cast("string")).alias("name"), text.alias("value")).repartition("name").write.partitionBy("name").text(path)
    names = files.select(F.explode(F.array(F.col("file"), -1 - F.col("file"))).alias("file")).select(F.concat(F.lit("name=f"), F.col("file").cast("string")))
    found = readers.read_json_files(t.spark, path, "doc_id long, n_chars long", names, default=[(-1, None)])
    return found.select(F.substring_index("name", "=f", -1).cast("long").alias("file"), "doc_id", "n_chars", "is_default")


@query(
    "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 2) THEN 'second' ELSE 'first' END AS run, o_totalprice FROM orders "
    "WHERE o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 2) OR o_orderkey % 2 = 0"
)
def project_outputs(t):
    """Outputs of all projects, two of them saved again with fewer rows, and a broken run without its markers."""
    rows = t("orders").select("o_orderkey", "o_orderpriority", F.lit("first").alias("run"), "o_totalprice")
    again = rows.join(F.broadcast(rows.select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(2)), "o_orderpriority", "left_semi")
    path = scratch(t.spark, "projects")
    sinks.save_projects(rows, path, "o_orderpriority")
    sinks.save_projects(again.filter("o_orderkey % 2 = 0").withColumn("run", F.lit("second")), path, "o_orderpriority")
    rows.withColumns({"run": F.lit("broken"), "_project": F.col("o_orderpriority"), "_run": F.lit("none")}).write.partitionBy("_project", "_run").mode("append").json(f"{path}/json")
    return sinks.saved_projects(t.spark, path, "o_orderkey long, o_orderpriority string, run string, o_totalprice double")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'a,\"b\"' ELSE c_mktsegment END AS note FROM customer")
def csv_output(t):
    """CSV with missing values, quotes and separators, as written and read back."""
    k = F.col("c_custkey")
    rows = t("customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_name")).alias("c_name"), F.when(k % 5 == 0, 'a,"b"').otherwise(F.col("c_mktsegment")).alias("note"))
    path = scratch(t.spark, "csv")
    sinks.save_records(rows, path, "csv")
    return t.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(f"{path}/csv")


@query(
    "SELECT 'orders' AS output, CASE WHEN count(*) > 50000 THEN 'csv' ELSE 'xlsx' END AS kind, count(*) > 0 AS has_output FROM orders UNION ALL SELECT 'nested', 'json', count(*) > 0 FROM orders "
    "UNION ALL SELECT 'small', CASE WHEN count(*) > 100 THEN 'csv' ELSE 'xlsx' END, count(*) > 0 FROM customer UNION ALL SELECT 'none', 'xlsx', FALSE"
)
def output_formats(t):
    """The format chosen for tables of all kinds, and whether what is written has rows."""
    orders, customers = t("orders"), t("customer").select("c_custkey")
    frames = {"orders": (orders, 50_000), "nested": (orders.select(F.array("o_orderkey").alias("keys")), 50_000), "small": (customers, 100), "none": (customers.filter("c_custkey IS NULL"), 50_000)}
    path = scratch(t.spark, "formats")
    rows = []
    for name, (frame, most) in frames.items():
        sinks.write_json(frame, f"{path}/{name}")
        rows.append((name, sinks.auto_format(frame, most), sinks.has_output(t.spark, f"{path}/{name}")))
    return t.spark.createDataFrame(rows, "output string, kind string, has_output boolean")
