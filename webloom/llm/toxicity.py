"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exceptions.

Folding lower-cases, drops accents, and reads homoglyphs and runs of digit or symbol substitutes in words as letters.
Lexicon entries are whole words or word beginnings (`stem*`). They and their weights are learned from labelled texts,
as are exception phrases, whose matches cancel the lexicon matches inside them.

Defined results: a null or empty text, or one without words, has no matches and the lowest score; repeated rows get
equal scores; with fewer than 5 labelled toxic texts, or none, the lexicon is empty and every score is that of a text
without matches, below one half; labels other than 0 and 1 are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import bounded, forget, give_back, save, slices

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k",
    "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p",
    "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
# Digits and symbols written in place of letters.
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_MARKS = re.compile("[̀-ͯ­​-‍⁠﻿]+")
# Runs of substitutes that touch a letter. After a word, `!` and `|` are punctuation or letters: matching tries both.
_INSIDE = re.compile(r"(?<![0-9@$!|])[0-9@$!|]++(?=[a-z])|(?<=[a-z])[0-9@$!|]*[0-9@$]")
_TOUCHING = re.compile(r"(?<![0-9@$!|])[0-9@$!|]++(?=[a-z])|(?<=[a-z])[0-9@$!|]+")
_LETTERS = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower-cased text without accents, look-alike letters read as Latin ones."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text).translate(_GLYPHS))


def fold(text: str) -> str:
    """plain() of a text with substitutes read as letters, character by character."""
    return _INSIDE.sub(lambda m: m[0].translate(_LETTERS), plain(text))


@dataclass
class Lexicon:
    """words and stems carry weights; `a + b * strength` is the logit of a text's score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    a: float = -3.0
    b: float = 1.0


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.found = lexicon, ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, part in (("word", lexicon.words), ("stem", lexicon.stems)):
            for term, weight in part.items():
                entries.setdefault(term, []).append((kind, weight))
        for phrase in lexicon.exceptions:
            entries.setdefault(phrase, []).append(("except", 0.0))
        for term, kinds in entries.items():
            self.found.add_word(term, (len(term), kinds))
        self.empty = not entries
        if not self.empty:
            self.found.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of lexicon matches in a plain() text, at word boundaries, outside exception phrases.

        Substitutes are read as letters here; a symbol that touches a match is a boundary as well.
        """
        if self.empty:
            return []
        out, spared = [], []
        for last, (n, kinds) in self.found.iter(_TOUCHING.sub(lambda m: m[0].translate(_LETTERS), text)):
            start, end = last + 1 - n, last + 1
            if start and text[start - 1].isalnum():
                continue
            ends = end == len(text) or not text[end].isalnum()
            for kind, weight in kinds:
                if kind == "except" and ends:
                    spared.append((start, end))
                elif kind == "stem" or kind == "word" and ends:
                    out.append((start, end, weight))
        return [h for h in out if not any(s <= h[0] and h[1] <= e for s, e in spared)] if spared else out

    def strength(self, text: str | None) -> tuple[float, int]:
        """(matched weight normalised by length, number of matches) of a whole text."""
        if not text:
            return 0.0, 0
        hits = self.hits(text := plain(text))
        if not hits:
            return 0.0, 0
        words = 1 + text.count(" ") + text.count("\n")
        return sum(h[2] for h in hits) / math.sqrt(1 + words / 100), len(hits)

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.lexicon.a + self.lexicon.b * strength))))


def _features(batches):
    """Distinct words and word beginnings of each labelled text, with its label."""
    for batch in slices(batches):
        names, labels = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(_WORD.findall(fold(text or "")))
            found = {f"{w}$" for w in words if len(w) > 2}
            for n in range(4, 8):
                found |= {f"{w[:n]}*" for w in words if len(w) >= n}
            names += found
            labels += [toxic] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(labels, pa.int32())], ["name", "toxic"])


def choose_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, least: float, precision: float) -> tuple[dict, dict]:
    """Words and stems whose texts are toxic far more often than chance; of nested ones the most telling form.

    counts: feature -> (toxic texts, clean texts). Among beginnings of one word the longest that still covers nearly
    all the texts of the shortest is kept; a whole word is kept in place of a beginning it accounts for, and where none
    of its beginnings tells as much.
    """
    floor = max(5, least * n_toxic)

    def rate(name: str) -> float:
        toxic, clean = counts[name]
        share = toxic / n_toxic
        return share / (share + (clean + 0.5) / max(n_clean, 1))

    good = {x for x in counts if counts[x][0] >= floor and rate(x) >= precision}
    words, stems = {}, {}
    weight = lambda x: math.log(((counts[x][0] + 0.5) / n_toxic) / ((counts[x][1] + 0.5) / max(n_clean, 1)))
    covered: set[str] = set()
    for name in sorted((x for x in good if x[-1] == "*"), key=lambda x: (len(x), x)):
        stem = name[:-1]
        if any(stem[:n] in covered for n in range(4, len(stem) + 1)):
            continue
        covered.add(stem)
        whole = [x for x in good if x[-1] == "$" and x.startswith(stem)]
        best = max(whole, key=lambda x: (counts[x][0], x), default=None)
        if best and counts[best][0] >= 0.9 * counts[name][0]:
            words[best[:-1]] = weight(best)
            continue
        longer = [x for x in good if x[-1] == "*" and x.startswith(stem) and counts[x][0] >= 0.95 * counts[name][0]]
        name = max(longer, key=lambda x: (len(x), x))
        stems[name[:-1]] = weight(name)
    for name in sorted(x for x in good if x[-1] == "$"):
        if not any(name[:n] in covered for n in range(4, len(name))):  # no beginning tells as much
            words[name[:-1]] = weight(name)
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, least: float = 0.004, precision: float = 0.95) -> Lexicon:
    """Learn a lexicon from docs (doc_id, text) and labels (doc_id, toxic), of which about `max_rows` are used at most.

    The labels are sampled before they meet the texts, so texts never move and what is broadcast is bounded. Half of
    the bound goes to each label; repeated labels and texts count once. A term must occur in 5 toxic texts, in the share `least`
    of the toxic sample and in so few clean texts that `precision` of its balanced occurrences are toxic. Terms and
    phrases reach the driver; they are those of the sample that occur in 5 of its texts or more.
    """
    labels = labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [bounded(labels.filter(F.col("toxic") == y), ["doc_id"], totals.get(y, 0), max_rows // 2, 8) for y in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))
    sample = docs.select("doc_id", "text").join(few, "doc_id").groupBy("toxic", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("i"))
    sample = save(sample.agg(F.first("text").alias("text")), "toxic-sample")
    if (rows := sample.count()) > 2 * max_rows:  # many documents of one id
        whole, sample = sample, save(bounded(sample, ["h"], rows, max_rows, 9), "toxic-sample")
        forget(whole)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        forget(sample)
        return Lexicon()
    features = sample.select("text", "toxic").mapInArrow(_features, "name string, toxic int")
    counted = features.groupBy("name").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    strong = counted.filter(F.col("t") >= max(5, least * n[1])).filter(
        F.col("t") / n[1] >= precision * (F.col("t") / n[1] + F.col("c") / max(n.get(0, 0), 1))
    )
    rows = strong.orderBy(F.desc("t"), "c", "name").collect()
    words, stems = choose_terms({r["name"]: (r["t"], r["c"]) for r in rows}, n[1], n.get(0, 0), least, precision)
    lexicon = Lexicon(words, stems)

    def beside(text: str, at: int, step: int) -> str:
        """The blank and word that touch place `at` of a text, before (step -1) or after it (step 1)."""
        blank = at - 1 if step < 0 else at
        if not (0 <= blank < len(text) and text[blank] == " "):
            return ""
        end = blank + step
        while 0 <= end < len(text) and text[end].isalnum():
            end += step
        word = text[blank + 1 : end] if step > 0 else text[end + 1 : blank]
        return (f" {word}" if step > 0 else f"{word} ") if word else ""

    def around(batches):
        """Each match with the word before or after it, once a text."""
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            phrases, labels = [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded, found = fold(text or ""), set()
                for s, e, _ in matcher.hits(plain(text or "")):
                    while e < len(folded) and folded[e].isalnum():
                        e += 1
                    before, after = beside(folded, s, -1), beside(folded, e, 1)
                    found |= {before + folded[s:e]} if before else set()
                    found |= {folded[s:e] + after} if after else set()
                phrases += found
                labels += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labels, pa.int32())], ["phrase", "toxic"])

    if words or stems:
        told = sample.select("text", "toxic").mapInArrow(around, "phrase string, toxic int").groupBy("phrase")
        told = told.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter("c >= 5 AND t * 20 <= c")
        lexicon.exceptions = [r["phrase"] for r in told.orderBy(F.desc("c"), "phrase").collect()]
    pairs = sample.select("text", "toxic").mapInArrow(_strengths(lexicon), "strength double, toxic int")
    points = pairs.groupBy("strength", "toxic").count().collect()  # at most max_rows of them
    forget(sample)
    lexicon.a, lexicon.b = _logistic(np.array([(r["strength"], r["toxic"], r["count"]) for r in points], dtype=float), totals)
    give_back()
    return lexicon


def _strengths(lexicon: Lexicon):
    def run(batches):
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            values = [matcher.strength(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column("toxic")], ["strength", "toxic"])

    return run


def _logistic(points: np.ndarray, totals: dict) -> tuple[float, float]:
    """Logistic fit of label on strength by Newton steps, each label weighted to its share of all labelled rows.

    A text without a match stays under one half, also where most labelled texts are toxic and few of them match.
    """
    x, y, w = points[:, 0], points[:, 1], points[:, 2].copy()
    for label in (0, 1):
        if (of := y == label).any():
            w[of] *= max(totals.get(label, 0), 1) / w[of].sum()
    w /= w.sum()
    a, b, ridge = -1.0, 1.0, 1e-4
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (p - y)).sum() + ridge * a, (w * (p - y) * x).sum() + ridge * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + ridge, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(min(a, -0.05)), float(max(b, 0.0))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs plus toxicity (0 to 1) and toxic_matches, over whole texts. Existing columns of these names are replaced."""

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            found = [matcher.strength(t) for t in batch.column(text).to_pylist()]
            new = {"toxicity": pa.array([matcher.score(s) for s, _ in found], pa.float64()), "toxic_matches": pa.array([n for _, n in found], pa.int64())}
            arrays = {n: batch.column(n) for n in batch.schema.names} | new
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    kept = docs.drop("toxicity", "toxic_matches")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, toxicity double, toxic_matches long")
