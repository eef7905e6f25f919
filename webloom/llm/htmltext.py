"""HTML main text by maximum-scoring subsequence.

A page is a sequence of text runs and tags. A run scores its number of words times a weight that is the sum of the
weights of the elements and classes it stands in; a tag scores below zero. The weights are log-odds learned from
labelled pages: those with exactly one `article` or `main` element, whose words are content and whose other words are
not. A linear scan finds the contiguous region with the highest total; runs of negative weight inside it are left out.

What a name's place outside of main elements taught says nothing inside one: there every run counts, lists, tables and
links too, but for what is marked as something else (notices, adverts, forms, reader comments). A mark is an element's
tag, or a class, id or role whose words all are known marks; words that name a text's subject as often (menu, cookies,
related, share) mark an element only if at least half of its words are links. Where main elements hold at least half of
a page's words that are not marked, no run outside of them counts. On other pages marks add to the learned weights,
except those of an element with most of the page's words, and the negative weights of lists, tables and divisions count
only where at least half of the words are links.

A page's elements are rows with a number and their parent's number; words are summed from children to parents and
weights from parents to children, so that the work is in proportion to the page however deep it is.

Blocks end at block-level tags; inline tags do not split a word's block, and `br` counts as white space. Character
references are decoded, white space becomes one space, blocks are trimmed, empty ones go, and the rest is joined by
one line end.

Defined results: null or empty html, and pages without a run of positive weight, give an empty text; markup cut off at
the end of a page is markup; of equally good regions the first wins; repeated rows get equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import bounded, slices

# Elements whose content is never text of the page.
SILENT = "script style noscript template svg iframe head title object canvas math audio video".split()
# Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that do not end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Elements and words of class, id or role that speak against main text.
ASIDE = set("nav footer aside form menu dialog button select textarea fieldset".split())
AROUND = set("nav footer aside dialog menu header".split())
MARKS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion dropdown footer header login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words beside a mark in a class or id that do not change its sense.
FILLER = set("site page box list section wrapper container block buttons button links link area bar inner text item items group main global top bottom left right".split())
# Marks that name what a text is about as often as what its element is, elements of running text, elements
# that menus and texts have alike, and elements whose words are links or controls.
UNSURE = set("banner consent cookie cookies disclaimer discussion header menu modal navigation pagination related search share sharing social widget".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption span em strong b i a code".split())
SHARED = set("ul ol li dl dt dd table thead tbody tr td th div section span a b i em strong img br".split())
LINKS = set("a button select".split())
# Start tags that end an open element of the kinds named.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
PRIOR = -8.0

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _share(tag: str, values: list[str], within: bool, linked: bool) -> float:
    """How far an element is marked as no main text, by its tag or by its names: class and id tokens, and role."""
    if tag in ASIDE or tag == "header" and not within:
        return 1.0
    best = 0.0
    for value in values:
        words = [w for w in re.split(r"[-_]+", value) if w and w not in FILLER] or [value]
        marks = [w in MARKS and not (within and w == "header") and not (w in UNSURE and (not linked if within else tag in RUNNING)) for w in words]
        if not within or all(marks):
            best = max(best, sum(marks) / len(marks))
    return best


class Page:
    """A page's elements, in order of their start tags, and its units: (element, tag or None, text or None) in order.

    Element 0 stands for the page. `fresh` are an element's names that no element around it has; `main` says whether it
    is or is inside an `article` or `main` element.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.values, self.fresh, self.main, self.silent = [0], [""], [[]], [()], [False], [False]
        self.units: list[tuple[int, str | None, str | None]] = []
        self.stack, self.open, self.names = [0], Counter(), Counter()
        for m in _PART.finditer(page):
            if (text := m["text"]) is not None:
                if not self.silent[self.stack[-1]]:
                    self.units.append((self.stack[-1], None, text))
            elif tag := m["name"] or m["name2"]:
                tag = tag.lower()
                if m["end"] or m["end2"]:
                    if self.open[tag]:
                        while self.shut() != tag:
                            pass
                else:
                    self.start(tag, m["attrs"] or m["attrs2"] or "")
                self.units.append((self.stack[-1], tag, None))
        self.words = [0] * len(self.tag)
        self.linked = [0] * len(self.tag)
        for e, _, text in self.units:
            if text is not None:
                self.words[e] += len(text.split())
        for e in range(len(self.tag) - 1, 0, -1):
            if self.tag[e] in LINKS:
                self.linked[e] = self.words[e]
            self.words[self.parent[e]] += self.words[e]
            self.linked[self.parent[e]] += self.linked[e]
        self.share = [0.0] * len(self.tag)
        for e in range(1, len(self.tag)):
            within = self.main[self.parent[e]]
            share = _share(self.tag[e], self.values[e], within, 2 * self.linked[e] >= self.words[e])
            self.share[e] = share if self.tag[e] not in ("article", "main", "html", "body") or share == 1.0 and self.tag[e] in ("article", "main") else 0.0

    def start(self, tag: str, attrs: str) -> None:
        top = lambda: self.tag[self.stack[-1]]
        if tag in CLOSES:
            while top() in CLOSES[tag]:
                self.shut()
        elif tag not in INLINE and top() == "p":
            self.shut()
        elif tag == "body":
            while top() not in ("", "html"):
                self.shut()
        if tag in VOID:
            return
        values = [v for a in _NAMED.findall(attrs) for v in " ".join(a).lower().split()]
        # Classes of html and body speak of the whole page, those of a main element count only as marks.
        names = () if tag in ("html", "body", "article", "main") else (f".{w}" for v in values for w in re.split(r"[-_]+", v) if w)
        own = tuple(dict.fromkeys((tag, *names)))
        above = self.stack[-1]
        self.fresh.append(tuple(n for n in own if not self.names[n]))
        self.parent.append(above)
        self.tag.append(tag)
        self.values.append(values)
        self.main.append(self.main[above] or tag in ("article", "main"))
        self.silent.append(self.silent[above] or tag in SILENT)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1
        self.names.update(self.fresh[-1])

    def shut(self) -> str:
        e = self.stack.pop()
        self.open[self.tag[e]] -= 1
        self.names.subtract(self.fresh[e])
        return self.tag[e]

    def marked(self) -> list[bool]:
        """Whether each element is or is inside one that is marked inside a main element, or is named as no main text around it."""
        out = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            own = self.share[e] > 0 and (self.main[self.parent[e]] or self.tag[e] in AROUND or self.tag[e] in ("article", "main"))
            out[e] = out[self.parent[e]] or own
        return out


def _labelled(batches):
    """(name, words or tags inside, outside the main element) of labelled pages."""
    for batch in slices(batches):
        inside, outside = Counter(), Counter()
        for html in batch.column("html").to_pylist():
            page = Page(html)
            marked = page.marked()
            own = [Counter(), Counter()]  # words or tags of each element itself, outside and inside
            for e, tag, text in page.units:
                if page.main[e] and marked[e]:
                    continue  # not told apart by the page's labels
                to = inside if page.main[e] else outside
                if tag:
                    to[f"<{tag}"] += 1
                elif n := len(text.split()):
                    to[""] += n
                    own[page.main[e]][e] += n
            for to, words in ((outside, own[0]), (inside, own[1])):
                for e in range(len(page.tag) - 1, 0, -1):
                    if words[e]:
                        words[page.parent[e]] += words[e]
                        for name in page.fresh[e]:
                            to[name] += words[e]
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], ["name", "inside", "outside"])


def fit(pages: DataFrame, max_rows: int = 4_000, least: int = 5) -> dict[str, float]:
    """Weights of names (elements and `.class` words) and of tags (`<tag`), from at most about `max_rows` labelled pages.

    Names with fewer than `least` words or tags in that sample have no weight, so what reaches the driver is bounded by
    the sample. Without any labelled page there are no weights, and marks alone decide.
    """
    labelled = pages.select("page_id", "html").filter(F.regexp_count("html", F.lit("(?i)<(article|main)[\\s>]")) == 1)
    sample = bounded(labelled, ["page_id", "html"], labelled.count(), max_rows, 10).select("html")
    counted = sample.mapInArrow(_labelled, "name string, inside long, outside long").groupBy("name")
    counted = counted.agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).filter(F.col("i") + F.col("o") >= least)
    return weigh({r["name"]: (r["i"], r["o"]) for r in counted.collect()})


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    total_i, total_o = (max(1, counts.get("", (0, 0))[k]) for k in (0, 1))
    out = {}
    for name, (i, o) in counts.items():
        if name in ("", "html", "body"):
            continue
        if name.startswith("<"):
            out[name] = -0.1 - 2.0 * (o + 1) / (i + o + 2)
        else:
            out[name] = max(-6.0, min(6.0, math.log((i / total_i + 1e-4) / (o / total_o + 1e-4))))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous run with the highest positive total, the first of equals; one linear scan."""
    best, low, low_at, total = (0.0, 0, 0), 0.0, 0, 0.0
    for at, score in enumerate(scores):
        total += score
        if total - low > best[0]:
            best = (total - low, low_at, at + 1)
        if total < low:
            low, low_at = total, at + 1
    return best[1:]


def _weights(page: Page, weights: dict[str, float]) -> tuple[list[float], bool]:
    """The weight of a word in each element, and whether only main elements hold main text."""
    marked, every = page.marked(), page.words[0]
    own = list(page.words)
    for e in range(len(own) - 1, 0, -1):
        own[page.parent[e]] -= page.words[e]
    central = sum(n for e, n in enumerate(own) if page.main[e] and not marked[e])
    aside = [False] * len(own)
    for e in range(1, len(own)):
        aside[e] = aside[page.parent[e]] or page.share[e] == 1.0 and (page.main[page.parent[e]] or 2 * page.words[e] <= every or page.tag[e] in AROUND)
    open_words = sum(n for e, n in enumerate(own) if not aside[e] and not page.main[e])
    only_main = central > 0 and central >= open_words
    total, share, out = [0.0] * len(own), [0.0] * len(own), [1.0] * len(own)
    for e in range(1, len(own)):
        above, tag = page.parent[e], page.tag[e]
        linked = 2 * page.linked[e] >= page.words[e]
        wide = 2 * page.words[e] > every and tag not in AROUND and not page.main[e]  # what wraps the page says nothing of its parts
        learned = 0.0
        for name in page.fresh[e]:
            w = weights.get(name, 0.0)
            if name not in ("html", "body") and not (w < 0 and (wide or name in SHARED and not linked)):
                learned += w
        total[e] = total[above] + learned
        share[e] = max(share[above], 0.0 if wide else page.share[e])
        if page.main[e]:
            out[e] = 0.0 if marked[e] else 1.0 + max(0.0, weights.get("article", 0.0), weights.get("main", 0.0))
        else:
            out[e] = -1.0 if only_main else 1.0 + max(-6.0, min(6.0, total[e])) + PRIOR * share[e]
    if only_main:
        out[0] = -1.0
    return out, only_main


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    seen = Page(page)
    known, only_main = _weights(seen, weights)
    least = -0.5 / len(seen.units) if seen.units else 0.0  # all together less than a word: does not cut off what follows
    scores = []
    for e, tag, text in seen.units:
        if tag:
            scores.append(least if only_main or seen.main[e] else weights.get(f"<{tag}", -1.0))
        elif only_main and not seen.main[e]:
            scores.append(least)
        else:
            scores.append(len(text.split()) * known[e])
    start, stop = best_region(scores)
    blocks, now = [], []
    for e, tag, text in [*seen.units[start:stop], (0, "p", None)]:
        if text is not None:
            if known[e] > 0:
                now.append(references.unescape(text))
        elif tag == "br":
            now.append(" ")
        elif tag not in INLINE:
            if line := " ".join("".join(now).split()):
                blocks.append(line)
            now = []
    return "\n".join(blocks)


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """pages (html) plus text and n_chars; existing columns of these names and html are dropped."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]

    def run(batches):
        for batch in slices(batches):
            texts = [extract(p, weights) for p in batch.column("html").to_pylist()]
            arrays = [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"])
    return pages.select(*(f"`{f.name}`" for f in kept), "html").mapInArrow(run, schema)
