"""URL filter: domain and path rules, then a weighted URL vocabulary counted by Aho-Corasick.

A term counts where no letter or digit of ASCII stands next to it in the URL with A-Z lower-cased. A URL is blocked on
one strict term, or on `least_soft` distinct soft terms whose weights reach `least_weight`. A rule overrides that.

Defined results: a null URL, or one without `://`, has an empty host and path, so no rule fits it; null has no term.
Of rules that fit, the longest wins, and of equally long ones the first in alphabetical order. Other columns are kept,
except those named host, path, rule, verdict, strict_terms and soft_terms, which are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that reject a URL on their own.
STRICT = ["spam", "porn", "xxx", "viagra", "cialis", "pills", "casino", "malware", "phishing", "warez", "escorts"]
# Terms that reject a URL in company, with their weights.
SOFT = {
    "cheap": 1.0, "free": 0.5, "bonus": 1.0, "click": 0.5, "win": 0.5, "prize": 1.0, "loan": 1.0, "bet": 1.0,
    "farm": 0.5, "deal": 0.5, "buy": 0.5, "promo": 0.5, "adult": 1.0, "crack": 1.0, "torrent": 1.0, "keygen": 1.0,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, rule) pairs that fits; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def terms(strict: list[str], soft: dict[str, float]):
    """A vectorized function: url -> distinct strict terms, distinct soft terms, weight of the soft ones."""
    kind = "strict_terms array<string>, soft_terms array<string>, soft_weight double"

    @F.arrow_udf(kind_of(kind))
    def find(urls: pa.Array) -> pa.Array:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            found.add_word(term, term)
        found.make_automaton()
        hard, easy = set(strict), set(soft)
        table = str.maketrans(UPPER, LOWER)
        out = []
        for url in urls.to_pylist():
            text, hits = (url or "").translate(table), set()
            for last, term in found.iter(text):
                before, after = text[last - len(term) : last + 1 - len(term)], text[last + 1 : last + 2]
                if last + 1 == len(term):
                    before = ""
                if not (_alnum(before) or _alnum(after)):
                    hits.add(term)
            own = sorted(hits & easy)
            out.append({"strict_terms": sorted(hits & hard), "soft_terms": own, "soft_weight": sum(soft[t] for t in own)})
        return pa.array(out, pa.struct([("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string())), ("soft_weight", pa.float64())]))

    return find


def kind_of(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in fields.split(", "))) + ">"


def _alnum(c: str) -> bool:
    return c != "" and (c in LOWER or c in "0123456789")


def judge(
    pages: DataFrame, rules: list[tuple[str, str]] = (), strict: list[str] = STRICT, soft: dict[str, float] = SOFT, least_soft: int = 2, least_weight: float = 1.5
) -> DataFrame:
    """pages (url) plus host, path, rule, verdict, strict_terms and soft_terms."""
    out = pages.drop("host", "path", "rule", "verdict", "strict_terms", "soft_terms")
    kept = out.columns
    out = out.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "found": terms(strict, soft)("url")})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), list(rules))
    bad = (F.size("found.strict_terms") > 0) | ((F.size("found.soft_terms") >= least_soft) & (F.col("found.soft_weight") >= least_weight))
    method = F.when(bad, "block").otherwise("allow")
    return out.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "found.strict_terms", "found.soft_terms")
