"""Packing into sequences as a cutting-stock problem, solved by column generation.

A document is its token ids and an end id. It is cut into pieces of `size`, a piece of a multiple of `grain`, and what
is left, so that the program has few rows. The histogram of piece lengths goes to the driver: a linear program over
patterns of lengths starts from one pattern per length; a knapsack dynamic program prices new patterns with the
program's dual values until the cost is within `gap` of the dual bound. A pattern costs `size`, or its own length where that is a power of two, as such sequences are not padded.
Pattern counts are rounded down, what is left is packed by best fit, and pieces, ranked within their length, take the
places of the patterns.

Ranks are counted in hashed shares of each length, so a length that holds a third of all pieces is not one task.

Defined results: null text counts as empty, which leaves the end id alone; repeated rows and null ids are packed like
others; an empty table gives no sequence.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import save, slices
from webloom.llm.tokens import WholeTokenizer


def cuts(n: int, size: int, grain: int) -> list[int]:
    """Where the pieces of n tokens end."""
    out = list(range(size, n + 1, size))
    rest = n % size
    if rest >= grain:
        out.append(n - rest % grain)
    return out if out and out[-1] == n else [*out, n]


def _pieces(tokenizer_path: str, size: int, end_id: int, grain: int):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        tokenizer = WholeTokenizer(tokenizer_path)
        for batch in slices(batches):
            source, start, length, crc, total = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = tokenizer.ids(text).tobytes() + end
                at = 0
                for stop in cuts(len(data) // 4, size, grain):
                    part = data[4 * at : 4 * stop]
                    source.append(row)
                    start.append(at)
                    at = stop
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
            ids = batch.column("doc_id").take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Prices:
    """The best patterns for given worths of the lengths, by an unbounded knapsack over the places of a sequence."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.size = size
        # Copies of a length by powers of two make up any number of them that fits.
        self.steps = [(i, k, int(n) * k) for i, n in enumerate(lengths) for k in (1 << p for p in range(size.bit_length())) if n * k <= size]
        self.costs = [1 << p for p in range(size.bit_length()) if 1 << p < size]

    def best(self, worth: np.ndarray) -> tuple[float, dict[int, int], int]:
        """(worth / cost, {index: copies}, cost) of the best pattern; one that fills a power of two costs that."""
        best = np.full(self.size + 1, -np.inf)
        best[0] = 0.0
        took = []
        for i, k, n in self.steps:
            value = best[:-n] + k * worth[i]
            better = value > best[n:]
            took.append(better)
            np.copyto(best[n:], value, where=better)
        fills = [(best[fill] / cost, fill, cost) for fill, cost in [(int(best.argmax()), self.size), *((p, p) for p in self.costs)]]
        ratio, c, cost = max(fills)
        pattern: Counter = Counter()
        for (i, k, n), better in zip(reversed(self.steps), reversed(took)):
            if c >= n and better[c - n]:
                pattern[i] += k
                c -= n
        return float(ratio), dict(pattern), cost


def solve(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float) -> tuple[list[tuple[dict[int, int], int]], np.ndarray, float]:
    """(patterns, times, share): a cover of the demands whose cost is at most 1 / share of the least possible.

    Column generation ends at the bound of the dual: the worths divided by the best pattern's ratio are a solution of
    it. Patterns are priced at worths between those of the best bound and the current ones, so that they don't swing. Of
    rows that would leave the basis at once, demands that each differ by a random share choose one: no basis comes back.
    """
    m = len(lengths)
    scale = float(demand @ lengths) / size
    need = demand / scale * (1 + 1e-5 * np.random.default_rng(m).random(m))
    basis = [({i: int(size // n)}, size) for i, n in enumerate(lengths)]
    cost = np.full(m, float(size))
    prices, bound, centre = Prices(lengths, size), 0.0, np.zeros(m)

    def refresh() -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros((m, m))
        for at, (copies, _) in enumerate(basis):
            whole[list(copies), at] = list(copies.values())
        inverse = np.linalg.inv(whole)
        return inverse, np.maximum(inverse @ need, 0)

    inverse, x = refresh()
    for turn in itertools.count(1):
        worth = cost @ inverse
        total = float(cost @ x)
        for share in (0.5, 0.0):  # of the best bound's worths, or else none of them
            asked = np.maximum(share * centre + (1 - share) * worth, 0)
            ratio, pattern, c = prices.best(asked)
            if (now := float(asked @ need) / max(ratio, 1.0)) > bound:
                bound, centre = now, asked / max(ratio, 1.0)
            if sum(worth[i] * n for i, n in pattern.items()) > c * (1 + gap / 4):
                break
        else:
            break  # no pattern is worth more than a little above its cost
        if total <= bound * (1 + gap):
            break
        column = inverse[:, list(pattern)] @ np.array(list(pattern.values()), dtype=float)
        ratios = np.where(column > 1e-7, x / np.where(column > 1e-7, column, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        x = np.maximum(x - step * column, 0)
        x[out] = step
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        basis[out], cost[out] = (pattern, c), c
        if turn % 100 == 0:
            inverse, x = refresh()
    return basis, x * scale, bound / total


def patterns(counts: dict[int, int], size: int, gap: float = 0.0005) -> list[tuple[dict[int, int], int]]:
    """(pattern {length: copies}, times) covering `counts` exactly, with a padding near the least possible.

    Lengths so rare that sequences of their own cost less than half of `gap` are left out of the program: demands in it
    are then within a factor that `gap` bounds, however skewed the counts.
    """
    plan = [({size: 1}, counts[size])] if counts.get(size) else []
    lengths = np.array(sorted(n for n in counts if n < size and counts[n] > 0), dtype=np.int64)
    if not len(lengths):
        return plan
    demand = np.array([counts[int(n)] for n in lengths], dtype=float)
    alone = np.ceil(demand / (size // lengths)) * size  # tokens and padding in sequences of that length only
    order = np.argsort(alone, kind="stable")
    rare = order[np.cumsum(alone[order]) <= gap / 2 * float(demand @ lengths)]
    program = np.setdiff1d(np.arange(len(lengths)), rare)
    left = {int(n): counts[int(n)] for n in lengths}
    wanted = [({int(n): int(size // n)}, counts[int(n)] / (size // n)) for n in lengths[rare]]
    if len(program):
        basis, times, _ = solve(lengths[program], demand[program], size, gap / 2)
        wanted += [({int(lengths[program][i]): n for i, n in copies.items()}, t) for (copies, _), t in sorted(zip(basis, times), key=lambda p: -p[1])]
    for pattern, times in wanted:
        times = min([int(times + 1e-9), *(left[n] // copies for n, copies in pattern.items())])
        if times > 0:
            plan.append((pattern, times))
            for n, copies in pattern.items():
                left[n] -= copies * times
    for n in left:  # what the program's small excess left of a frequent length
        if times := left[n] // (size // n) if left[n] > 100 * (size // n) else 0:
            plan.append(({n: size // n}, times))
            left[n] -= times * (size // n)
    return plan + [(dict(Counter(b)), 1) for b in best_fit([n for n in sorted(left, reverse=True) for _ in range(left[n])], size)]


def best_fit(pieces: list[int], size: int) -> list[list[int]]:
    """Each piece, longest first, into the fullest sequence that has room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    for n in pieces:
        fit = min((r for r, b in room.items() if r >= n and b), default=None)
        if fit is None:
            bins.append([])
            at, fit = len(bins) - 1, size
        else:
            at = room[fit].pop()
        bins[at].append(n)
        room.setdefault(fit - n, []).append(at)
    return bins


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, grain: int = 16) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, size, end_id, grain), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = save(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size / grain + grain rows
    rows, base = [], 0
    taken: Counter = Counter()
    for pattern, times in patterns(counts, size):
        at = 0
        for n, copies in sorted(pattern.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + times * copies, copies, base, at))
            taken[n] += times * copies
            at += n * copies
        base += times
    # A row per length of each pattern: one pattern per piece length, and what rounding left of them.
    plan = F.broadcast(spark.createDataFrame(rows, "length long, low long, high long, copies long, base long, at long"))
    shares = max(64, -(-max(counts.values(), default=0) // 100_000))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)))
    before = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = before.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(plan, "length").filter("rank >= low AND rank < high").withColumn("k", F.col("rank") - F.col("low"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(F.col("k") / F.col("copies")).cast("long")).alias("sequence_id"),
        (F.col("at") + F.pmod("k", "copies") * F.col("length")).alias("offset"),
    )
