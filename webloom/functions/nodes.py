"""The one HTML helper: pages to pre-order node arrays, and selectors as conditions on nodes."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (
    "node_id:int parent_id:int subtree_end:int depth:int place:int nth:int tag:string id:string classes:array<string> attrs:map<string,string> "
    "texts:array<struct<at:int,s:string>> words:array<struct<at:int,s:string>> label:string in_chrome:boolean"
).split()
NODE = f"array<struct<{','.join(FIELDS)}>>"
# Elements without an end tag, and start tags that end an open element of the kinds named.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME = {"nav", "header", "footer"}
LABELLED, LABEL = {"a", "button"}, 20  # elements whose whole text is kept, if it has at most so many characters that are no blanks
HELD = 1 << 18  # bytes of html whose trees are held at once; a longer page is held alone


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.tags, self.kids = [], [], Counter(), {}
        self.at, self.raw, self.inked = 0, [], [0]  # texts and comments so far, texts so far, characters of them that are no blanks

    def add(self, tag: str, attrs: dict) -> dict:
        parent = self.open[-1] if self.open else None
        above = parent["node_id"] if parent else None
        kids = self.kids.setdefault(above, Counter())
        kids[tag] += 1
        node = {
            "node_id": len(self.nodes), "parent_id": above, "subtree_end": 0, "depth": len(self.open) + 1, "place": kids.total(), "nth": kids[tag], "tag": tag, "id": attrs.get("id"), "classes": (attrs.get("class") or "").split(),
            "attrs": list(attrs.items()), "texts": [], "words": [], "label": None, "begun": len(self.raw), "in_chrome": tag in CHROME or bool(parent and parent["in_chrome"]),
        }
        self.nodes.append(node)
        return node

    def ensure(self, tag: str):
        """html and body come first when the page leaves them out."""
        if not self.nodes and tag != "html":
            self.enter(self.add("html", {}))
        if len(self.open) == 1 and tag not in ("html", "head", "body"):
            self.enter(self.add("body", {}))

    def enter(self, node: dict):
        self.open.append(node)
        self.tags[node["tag"]] += 1

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n["tag"] == tag for n in self.nodes):
            return
        if tag == "body":
            while len(self.open) > 1:
                self.shut()
        if tag in CLOSES:
            while self.open and self.open[-1]["tag"] in CLOSES[tag]:
                self.shut()
        self.ensure(tag)
        node = self.add(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            node["subtree_end"] = len(self.nodes)
            del node["begun"]
        else:
            self.enter(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def shut(self):
        node = self.open.pop()
        node["subtree_end"] = len(self.nodes)
        self.tags[node["tag"]] -= 1
        begun = node.pop("begun")
        if node["tag"] in LABELLED and self.inked[-1] - self.inked[begun] <= LABEL:
            node["label"] = "".join(self.raw[begun:]).strip()

    def handle_endtag(self, tag):
        if self.tags[tag]:
            while self.open[-1]["tag"] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data):
        if data.strip():
            self.ensure("#text")
        if self.open:
            self.at += 1
            self.open[-1]["texts"].append({"at": self.at, "s": data})
            self.raw.append(data)
            self.inked.append(self.inked[-1] + sum(map(len, data.split())))
            if data.strip():
                self.open[-1]["words"].append({"at": self.at, "s": data.strip()})

    def handle_comment(self, data):
        if self.open:
            self.at += 1
            self.open[-1]["texts"].append({"at": self.at, "s": data})

    def result(self) -> list[dict]:
        while self.open:
            self.shut()
        return self.nodes


def parse(page: str | None) -> list[dict] | None:
    if page is None:
        return None
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.result()


def words_of(nodes: list[dict], at: int) -> str:
    """All stripped text in the subtree of a node of parse(), joined."""
    inside = [w for n in nodes[at : nodes[at]["subtree_end"]] for w in n["words"]]
    return "".join(w["s"] for w in sorted(inside, key=lambda w: w["at"]))


def parse_with_text(page: str | None) -> list[dict]:
    """Nodes with the `text` of their subtrees, for plug-ins."""
    nodes = parse(page) or []
    for n in nodes:
        n["text"] = words_of(nodes, n["node_id"])
    return nodes


def _offsets(sizes) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]), pa.int32())


def _nodes(pages: pa.Array) -> pa.Array:
    """The trees of pages, built column by column."""
    trees = [parse(p) for p in pages.to_pylist()]
    flat = [n for t in trees for n in t or ()]
    plain = {"node_id": pa.int32(), "parent_id": pa.int32(), "subtree_end": pa.int32(), "depth": pa.int32(), "place": pa.int32(), "nth": pa.int32(), "tag": pa.string(), "id": pa.string(), "label": pa.string(), "in_chrome": pa.bool_()}
    columns = {name: pa.array([n[name] for n in flat], kind) for name, kind in plain.items()}
    columns["classes"] = pa.ListArray.from_arrays(_offsets([len(n["classes"]) for n in flat]), pa.array([x for n in flat for x in n["classes"]], pa.string()))
    pairs = [x for n in flat for x in n["attrs"]]
    columns["attrs"] = pa.MapArray.from_arrays(_offsets([len(n["attrs"]) for n in flat]), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    for name in ("texts", "words"):
        own = [x for n in flat for x in n[name]]
        pieces = pa.StructArray.from_arrays([pa.array([x["at"] for x in own], pa.int32()), pa.array([x["s"] for x in own], pa.string())], ["at", "s"])
        columns[name] = pa.ListArray.from_arrays(_offsets([len(n[name]) for n in flat]), pieces)
    names = [f.split(":")[0] for f in FIELDS]
    ends = np.cumsum([0, *(len(t or ()) for t in trees)]).tolist()
    starts = [None if t is None else at for t, at in zip(trees, ends)]
    return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), pa.StructArray.from_arrays([columns[n] for n in names], names))


def _light(pages: pa.Array) -> Iterator[pa.Array]:
    """The pages in slices of at most HELD bytes; a longer page is a slice alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(pages):
        before = int(ends[at - 1]) if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + HELD, "right"))), at + 1024)
        yield pages.slice(at, stop - at)
        at = stop


def _node_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """_nodes() slice by slice, each sent on alone: what a task holds doesn't grow with the rows of Spark's batches."""
    for pages in batches:
        for part in _light(pages):
            yield _nodes(part)


def html_nodes(page: str | Column) -> Column:
    """Node arrays of html pages.

    subtree_end is the first node id after the subtree; place and nth count siblings, all and of one tag, from 1; texts
    are a node's own pieces of text and comments with their place in the page; words are its own stripped texts; label is
    the whole text of a link or button, stripped at its ends, where that is short.
    """
    return F.arrow_udf(_node_batches, NODE)(page)


def subtree(nodes: Column, node: Column) -> Column:
    """A node and all nodes inside it, of a page's nodes or of a subtree that holds it."""
    return F.slice(nodes, node["node_id"] - nodes[0]["node_id"] + 1, node["subtree_end"] - node["node_id"])


def text_of(nodes: Column, node: Column) -> Column:
    """All stripped text in a node's subtree, joined; that of a leaf without a look at other nodes."""
    joined = lambda words: F.array_join(F.transform(words, lambda w: w["s"]), "")
    below = F.array_sort(F.flatten(F.transform(subtree(nodes, node), lambda n: n["words"])))
    return F.when(node["subtree_end"] == node["node_id"] + 1, joined(node["words"])).otherwise(joined(below))


_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(\*?=)[\"']?([^\"'\]]*)[\"']?)?\]|:nth-of-type\((\d+)\)")


def tests_of(text: str) -> list[tuple[str, ...]]:
    """The tests of a compound `tag#id.class[attr][attr=v][attr*=v]:nth-of-type(n)`; other selectors are errors."""
    at, out = 0, []
    for m in _COMPOUND.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        tag, ident, cls, attr, op, value, nth = m.groups()
        found = {"tag": tag if tag != "*" else None, "id": ident, "class": cls, "nth": nth}
        out += [(kind, x) for kind, x in found.items() if x]
        if attr:
            out.append((f"attr{op or ''}", attr, value or ""))
    if at != len(text) or not text:
        raise ValueError(f"selector not supported: {text}")
    return out


def compound(node: Column, text: str) -> Column:
    """Condition that a node matches a compound."""
    test = F.lit(True)
    for kind, x, *value in tests_of(text):
        own = {"tag": lambda: node["tag"] == x, "id": lambda: node["id"] == x, "class": lambda: F.array_contains(node["classes"], x), "nth": lambda: node["nth"] == int(x)}.get(kind)
        if own is None:
            has = node["attrs"][x]
            own = {"attr": has.isNotNull, "attr=": lambda: has == value[0], "attr*=": lambda: has.contains(value[0])}[kind]
        test = test & own()
    return F.coalesce(test, F.lit(False))


def steps_of(text: str) -> list[list[tuple[bool, list[tuple[str, ...]]]]]:
    """The chains of a selector list, each of (child of the step before, tests)."""
    out = []
    for one in text.split(","):
        steps, child = [], False
        for word in one.replace(">", " > ").split():
            if word == ">":
                if child or not steps:
                    raise ValueError(f"selector not supported: {text}")
                child = True
            else:
                steps.append((child, tests_of(word)))
                child = False
        if child or not steps:
            raise ValueError(f"selector not supported: {text}")
        out.append(steps)
    return out


def _fits(node: dict, tests: list[tuple[str, ...]], attrs: dict) -> bool:
    for kind, x, *value in tests:
        if kind == "tag" or kind == "id":
            ok = node[kind] == x
        elif kind == "class":
            ok = x in node["classes"]
        elif kind == "nth":
            ok = node["nth"] == int(x)
        else:
            own = attrs.get(x)
            ok = own is not None and (kind == "attr" or (own == value[0] if kind == "attr=" else value[0] in own))
        if not ok:
            return False
    return True


class Matches:
    """Selectors given as data, on the nodes of one page: each selector looks at every node once, however deep it is.

    `compiled` keeps the steps of selectors for further pages.
    """

    def __init__(self, nodes: list[dict], compiled: dict[str, list] | None = None):
        self.nodes, self.found, self.compiled = nodes, {}, {} if compiled is None else compiled
        self.attrs = [dict(n["attrs"]) for n in nodes]

    def of(self, selector: str) -> list[int]:
        """Ids of the nodes that match a selector list, in document order."""
        if selector not in self.found:
            if selector not in self.compiled:
                self.compiled[selector] = steps_of(selector)
            hits = set()
            for steps in self.compiled[selector]:
                last = inside = None  # nodes that the steps so far end at, and nodes at or below such
                for child, tests in steps:
                    now, below = bytearray(len(self.nodes)), bytearray(len(self.nodes))
                    for n in self.nodes:
                        i, up = n["node_id"], n["parent_id"]
                        now[i] = _fits(n, tests, self.attrs[i]) and (last is None or up is not None and (last if child else inside)[up])
                        below[i] = now[i] or up is not None and below[up]
                    last, inside = now, below
                hits.update(i for i, hit in enumerate(last) if hit)
            self.found[selector] = sorted(hits)
        return self.found[selector]

    def chain(self, selectors: list[str], start: int = 0) -> list[int]:
        """What a chain of selectors ends at: each looks at the nodes that the one before found and at all inside them."""
        scopes = [start] if self.nodes else []
        for selector in selectors:
            ids, out, done = self.of(selector), [], 0
            for scope in scopes:  # in document order, so what was taken once lies before `done`
                low = max(bisect_left(ids, scope), done)
                high = bisect_left(ids, self.nodes[scope]["subtree_end"])
                out += ids[low:high]
                done = max(done, high)
            scopes = out
        return scopes


def matches(nodes: Column, node: Column, text: str) -> Column:
    """Condition that a node of `nodes` matches a selector list of descendant (` `) and child (`>`) chains."""
    out = F.lit(False)
    for one in text.split(","):
        out = out | _chain(nodes, node, one.replace(">", " > ").split())
    return out


def _chain(nodes: Column, node: Column, steps: list[str]) -> Column:
    test = compound(node, steps[-1])
    if len(steps) == 1:
        return test
    if steps[-2] == ">":
        parent = F.get(nodes, node["parent_id"] - nodes[0]["node_id"])
        return test & F.coalesce(_chain(nodes, parent, steps[:-2]), F.lit(False))
    above = lambda a: (a["node_id"] < node["node_id"]) & (node["node_id"] < a["subtree_end"]) & _chain(nodes, a, steps[:-1])
    return test & F.exists(nodes, above)


def select(nodes: Column, text: str) -> Column:
    """The nodes that match a selector, in document order."""
    return F.filter(nodes, lambda n: matches(nodes, n, text))
