"""Benchmark decontamination by greedy string tiling.

A token is a 64-bit hash of a lower-cased run of letters and digits, a seed a run of `k` tokens by rolling hash. The
benchmark's seeds set the bits of a filter of bounded size, which is broadcast; from each document only the tokens of
seeds in it are taken on, once for equal texts. Their seeds are joined with the benchmark's seeds on Spark, which
gives the pairs of a text and an item that share enough of them. Each pair is tiled: the longest common run of
unmarked tokens, found by running Karp-Rabin, is marked again and again until none of `k` tokens is left. An item is
leaked into a document if the tiles cover at least `threshold` of its tokens, in any order.

A tile of k tokens or more has a seed, so an item of n tokens is covered only if `threshold * n / k` of its seeds are
met; texts that meet fewer than any item takes go no further. Half as many, those that the most items have, take no part in the join, so a phrase of every item pairs nothing.

Defined results: null or empty texts, and items with fewer than `k` tokens, match nothing; repeated rows of the
benchmark count once, repeated documents give repeated results; null ids are carried; an empty table on either side
finds nothing; extra columns of the documents are kept by clean(), whatever their names.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import bit_filter, forget, passes, save, slices
from webloom.llm.shingles import BASE, mix, word_hashes

BETWEEN = re.compile(r"[\W_]+")
STOP = word_hashes(b"\x01")[0]  # stands between texts that are hashed at once
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VOLUME = 1 << 20  # characters of texts that are hashed at once


def hashed(texts: list[str | None]) -> np.ndarray:
    """Token hashes of texts in order, STOP after each text."""
    flat = [BETWEEN.sub(" ", t.lower()) if t else "" for t in texts]
    return word_hashes(" \x01 ".join([*flat, ""]).encode("utf-8", "surrogatepass"))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k tokens: one running sum of a polynomial, of which windows are differences."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down, dtype=np.uint64)])
    return mix((total[k:] - total[:-k]) * up[k - 1 :])


class _Side:
    """One side of a tiling: its tokens, which of them are free, and the hashes of its windows of any length."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.free = tokens, tokens >= 0
        n = len(tokens)
        up, down = np.full(n, BASE), np.full(n, INVERSE)
        up[:1] = down[:1] = 1
        self.up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.view(np.uint64) * down, dtype=np.uint64)])

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of s free tokens, from one running sum for all lengths."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[s:] == taken[:-s])
        return at, mix((self.total[at + s] - self.total[at]) * self.up[at + s - 1])


def tile(a, b, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of non-overlapping common runs of at least k tokens.

    Negative tokens match nothing. The longest length at which windows of both sides meet is found by halving the
    range of lengths; all runs of that length are marked, the first in a with the first in b, before the next length.
    Hashes that meet are compared token by token.
    """
    left, right = (_Side(np.asarray(x, dtype=np.int64)) for x in (a, b))
    same = lambda i, j, s: np.array_equal(left.tokens[i : i + s], right.tokens[j : j + s])

    def meets(s: int) -> bool:
        (i, x), (j, y) = left.windows(s), right.windows(s)
        both, first, second = np.intersect1d(x, y, return_indices=True)
        return any(same(i[first[n]], j[second[n]], s) for n in range(len(both)))

    tiles, most = [], min(len(left.tokens), len(right.tokens))
    while most >= k and meets(k):
        low, high = k, most
        while low < high:
            s = (low + high + 1) // 2
            low, high = (s, high) if meets(s) else (low, s - 1)
        (at, x), (there, y) = left.windows(low), right.windows(low)
        held = np.isin(y, x)
        places: dict[int, deque[int]] = {}
        for j, h in zip(there[held].tolist(), y[held].tolist()):
            places.setdefault(h, deque()).append(j)
        held = np.isin(x, y)
        for i, h in zip(at[held].tolist(), x[held].tolist()):
            if not (left.free[i] and left.free[i + low - 1]):
                continue
            found = places[h]
            while found and not (right.free[found[0]] and right.free[found[0] + low - 1]):
                found.popleft()
            if found and same(i, found[0], low):
                j = found.popleft()
                left.free[i : i + low] = right.free[j : j + low] = False
                tiles.append((i, j, low))
        most = low - 1
    return tiles


def _tokens(words: np.ndarray) -> np.ndarray:
    """Token hashes as non-negative longs."""
    return (words >> np.uint64(1)).view(np.int64)


def _items(k: int):
    """(item, item_id, words, seeds) of the benchmark's texts."""

    def run(batches):
        for batch in slices(batches):
            words = [hashed([t])[:-1] for t in batch.column("text").to_pylist()]
            lists = ([_tokens(w) for w in words], [rolling(w, k).view(np.int64) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["item", "item_id", "words", "seeds"])

    return run


def _hits(shared, k: int, least: int):
    """Of each text the seeds that the filter knows and their tokens, -1 between runs; texts with fewer than `least` seeds are left out."""

    def found(texts: list[str | None]):
        words = hashed(texts)
        ends = np.flatnonzero(words == STOP)
        seeds = rolling(words, k)
        known = np.flatnonzero(passes(shared.value, seeds))
        owner = np.searchsorted(ends, known)
        whole = known + k <= ends[owner]  # a window with a STOP inside is none
        known, owner = known[whole], owner[whole]
        for text in np.unique(owner):
            own = known[owner == text]
            if len(distinct := np.unique(seeds[own])) < least:
                continue
            inside = np.unique((own[:, None] + np.arange(k)).ravel())
            cuts = np.flatnonzero(np.diff(inside) > 1) + 1
            yield int(text), np.insert(_tokens(words[inside]), cuts, -1), distinct.view(np.int64)

    def run(batches):
        for batch in slices(batches):
            texts, rows, at = batch.column("text").to_pylist(), [], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= VOLUME):
                    size += len(texts[stop] or "")
                    stop += 1
                rows += [(at + i, seq, seeds) for i, seq, seeds in found(texts[at:stop])]
                at = stop
            some = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            lists = (pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "h1", "h2")), *lists], ["doc_id", "h1", "h2", "seq", "seeds"])

    return run


def _tiled(k: int, threshold: float):
    """Rows (h1, h2, item_id, words, seq): the leaked ones with their coverage."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for row, (item, seq) in enumerate(zip(batch.column("words"), batch.column("seq"))):
                item, seq = (x.values.to_numpy() for x in (item, seq))
                tiles = tile(item, seq, k)
                covered = sum(x[2] for x in tiles)
                if covered >= threshold * len(item):
                    rows.append((row, covered / len(item), len(tiles), covered, len(item)))
            some = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("h1", "h2", "item_id")), *(pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds))], ["h1", "h2", "item_id", "coverage", "n_tiles", "covered_tokens", "item_tokens"])

    return run


def _key(text: str = "text"):
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def _leaked(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of documents (doc_id, text) with a known seed; (h1, h2, item_id, ...) of leaked texts and items."""
    name = benchmark.schema["item_id"].dataType.simpleString()
    texts = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct().withColumn("item", F.monotonically_increasing_id())
    items = save(texts.mapInArrow(_items(k), f"item long, item_id {name}, words array<long>, seeds array<long>").filter("size(seeds) > 0"), "items")
    # Half as many seeds as an item needs, those that the most items have, are left out.
    seeds = items.select("item", F.size("words").alias("n"), F.explode("seeds").alias("seed")).groupBy("item", "n", "seed").agg(F.count("*").alias("copies"))
    common = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item").orderBy(F.desc("items"), "seed")
    ranked = seeds.join(common, "seed").withColumn("need", F.ceil(F.lit(threshold) * F.col("n") / k))
    ranked = ranked.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = save(ranked.select("item", "seed", "copies", "need", (F.col("upto") <= F.floor(F.col("need") / 2)).alias("out")), "seeds")
    used = ranked.filter("NOT out")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ranked.select("seed"), 8192))  # a text has many seeds to try
    fewest = ranked.groupBy("item").agg(F.ceil(F.max("need") / F.max("copies")).alias("n"))  # distinct seeds that an item takes
    least = fewest.agg(F.min("n")).first()[0] or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = save(docs.select("doc_id", "text", *_key()).mapInArrow(_hits(shared, k, least), f"doc_id {kind}, h1 long, h2 long, seq array<long>, seeds array<long>"), "hits")
    once = hits.groupBy("h1", "h2").agg(F.first("seeds").alias("seeds")).select("h1", "h2", F.explode("seeds").alias("seed"))
    pairs = once.join(used, "seed").groupBy("h1", "h2", "item").agg(F.sum("copies").alias("met"), F.first("need").alias("need"))
    pairs = pairs.filter("met >= greatest(need - floor(need / 2), 1)").select("h1", "h2", "item")
    seqs = hits.groupBy("h1", "h2").agg(F.first("seq").alias("seq"))
    both = pairs.join(seqs, ["h1", "h2"]).join(items.select("item", "item_id", "words"), "item")
    schema = f"h1 long, h2 long, item_id {name}, coverage double, n_tiles int, covered_tokens int, item_tokens int"
    found = save(both.select("h1", "h2", "item_id", "words", "seq").mapInArrow(_tiled(k, threshold), schema), "leaked")
    forget(items, ranked)
    shared.unpersist()
    return hits, found


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, covered_tokens, item_tokens) of each document of docs (doc_id, text) and benchmark item leaked into it."""
    hits, found = _leaked(docs, benchmark, k, threshold)
    out = save(hits.select("doc_id", "h1", "h2").join(found, ["h1", "h2"]).drop("h1", "h2"), "leaks")
    forget(hits, found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, into whose text no benchmark item is leaked.

    Texts are told apart by a hash of 128 bits; they stay where they are unless the leaked ones outgrow Spark's
    limit of a broadcast.
    """
    hits, found = _leaked(docs, benchmark, k, threshold)
    own = ["_" * (1 + max(map(len, docs.columns))) + c for c in ("h1", "h2")]  # names that docs can't have
    bad = found.select("h1", "h2").distinct().toDF(*own)
    h1, h2 = _key()
    out = docs.join(bad, (h1 == F.col(own[0])) & (h2 == F.col(own[1])), "left_anti")
    forget(hits)
    return out
