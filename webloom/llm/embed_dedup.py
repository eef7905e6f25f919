"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are split into halves; independent codebooks on either half form a product grid of cells. Every vector
lies in one cell and visits the cells nearest to it, in the order of the multi-sequence algorithm, until the target
recall: as many as found that share of test vectors that were turned away from sample vectors by exactly the
threshold's angle. Neighbouring cells of a grid row are one unit of about `block` points, and a vector is sent once to
each unit in which it visits a cell. Two vectors are compared if either visits the other's unit; cosine is verified in
double precision.

Equal vectors of a label are one point with a count. Units are cut into blocks of points and of visitors, so a dense
cell is many tasks; a task sends counts of links and a spanning forest of them, never all pairs. The codebooks grow
with the root of the number of points, up to an eighth of the sample they are fitted on.

Defined results: vectors that are null or zero, or hold null or non-finite components, and rows with a null label or
id, have no link and are kept; ids are read as longs, so a text id is a null one; vectors of different lengths are never linked; rows with equal ids count as separate
vectors of one component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import bounded, save, settled
from webloom.llm.components import connected_components


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = squares(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, n: int) -> list[int]:
    """The n cells (i * len(d2) + j) with the smallest d1[i] + d2[j], nearest first."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, out, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * len(d2) + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(d1) and b < len(d2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


class Index:
    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float, wide: int = 1, tests: int = 2_000, seed: int = 6):
        x = unit(sample)
        self.cut, self.wide = x.shape[1] // 2 or 1, wide
        self.first, self.second = kmeans(x[:, : self.cut], codes), kmeans(x[:, self.cut :] if x.shape[1] > 1 else x, codes)
        # Near codes of the second half get near numbers, so that a tour's cells share units.
        centred = self.second - self.second.mean(axis=0)
        self.second = self.second[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
        rng = np.random.default_rng(seed)
        some = x[rng.integers(0, len(x), tests)]
        noise = rng.normal(size=some.shape)
        noise -= (noise * some).sum(axis=1, keepdims=True) * some
        turned = threshold * some + math.sqrt(1 - threshold**2) * noise / np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12)
        cells = self.cells(some)
        d1, d2 = self.distances(turned)
        own = d1[np.arange(tests), cells // len(self.second)] + d2[np.arange(tests), cells % len(self.second)]
        rank = np.array([np.searchsorted(np.sort(d2[t]), own[t] - d1[t], "left").sum() for t in range(tests)])
        self.visits = int(np.sort(rank)[min(tests - 1, math.ceil(recall * tests))]) + 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, : self.cut], self.first), squares(x[:, self.cut :] if x.shape[1] > 1 else x, self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def units(self, cells: np.ndarray) -> np.ndarray:
        """The unit of each cell: `wide` neighbouring cells of a grid row."""
        row, column = np.divmod(cells, len(self.second))
        return row * -(-len(self.second) // self.wide) + column // self.wide

    def tour(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return self.units(np.array([multi_sequence(a, b, self.visits) for a, b in zip(d1, d2)]))


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _compare(threshold: float):
    """Rows of a block come first, then its visitors; sends (a, n) for n links of a, and (a, b) for edges."""

    def run(batches):
        key, block = None, []
        for batch in batches:
            a, b, n = [], [], []
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("label", "dim", "cell", "pb", "vb"))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                ids, count = part.column("rep").to_numpy(), part.column("n").to_numpy()
                visitor = part.column("visitor").to_numpy(zero_copy_only=False)
                x, home = unit(_rows(part.column("embedding"))), part.column("home").to_numpy()
                if keys[start] != key:
                    key, block, joined = keys[start], [], None
                if (~visitor).any():
                    own = np.flatnonzero(~visitor)
                    block.append((ids[own], count[own], x[own], _rows(part.column("tour").take(pa.array(own)))))
                if not visitor.any() or not block:
                    continue
                if len(block) > 1 or joined is None:
                    block = [tuple(np.concatenate(p) for p in zip(*block))]
                    joined = np.arange(len(block[0][0])) if joined is None else joined
                bi, bn, bx, tours = block[0]
                who = np.flatnonzero(visitor)
                for at in range(0, len(who), 256):
                    w = who[at : at + 256]
                    near = (x[w] @ bx.T >= threshold) & (ids[w][:, None] != bi[None])
                    lone = np.zeros_like(near)  # pairs that only this side's visit finds
                    for r in np.flatnonzero(near.any(axis=1)):
                        to = np.flatnonzero(near[r])
                        lone[r, to] = (tours[to] != home[w[r]]).all(axis=1)
                    for total, names in ((near @ bn, ids[w]), (count[w] @ lone, bi)):
                        got = np.flatnonzero(total)
                        a.extend(names[got].tolist())
                        b.extend([None] * len(got))
                        n.extend(total[got].tolist())
                    for r in np.flatnonzero(near.any(axis=1)):
                        to = np.flatnonzero(near[r])
                        groups, first = np.unique(joined[to], return_index=True)
                        a.extend([int(ids[w[r]])] * len(first))
                        b.extend(bi[to[first]].tolist())
                        n.extend([None] * len(first))
                        if len(groups) > 1:
                            joined[np.isin(joined, groups)] = groups[0]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, sample_rows: int = 20_000, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Each length of vectors with more than `block` points has codebooks of its own, fitted on about `sample_rows` points;
    every vector is indexed and visits. All other lengths are one cell each, compared exactly in one job.
    """
    return settled(lambda: _near_duplicates(vectors, threshold, recall, sample_rows, block), "near-vectors")


def _near_duplicates(vectors: DataFrame, threshold: float, recall: float, sample_rows: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    e = F.col("embedding")
    sound = e.isNotNull() & F.exists(e, lambda x: x != 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.withColumn("usable", F.coalesce(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    points = rows.filter("usable").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    points = save(points.withColumn("dim", F.size("embedding")), "points")
    sizes = save(points.groupBy("dim").agg(F.count("*").alias("total")), "sizes")
    parts = []
    for dim, total in sizes.filter(F.col("total") > block).orderBy("dim").collect():
        own = points.filter(F.col("dim") == dim)
        taken = np.array([r["embedding"] for r in bounded(own, ["rep"], total, sample_rows, 7).select("embedding").collect()], dtype=np.float64)
        codes = int(min(max(2, math.sqrt(total / 64)), max(1, len(taken) // 8 + 1)))
        index = Index(taken, codes, threshold, recall, wide=max(1, min(codes, block * codes**2 // total)))
        parts.append(save(own.mapInArrow(_tours(spark.sparkContext.broadcast(vars(index)), kind), f"label string, dim int, rep long, n long, embedding array<{kind}>, home int, tour array<int>"), "tours"))
    few = sizes.filter(F.col("total") <= block).select("dim")
    if not few.isEmpty():
        one = points.join(F.broadcast(few), "dim").select("label", "dim", "rep", "n", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
        parts.append(save(one.withColumns({"home": F.lit(0), "tour": F.array(F.lit(0))}), "tours"))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = None
    for tours in parts:
        visits = tours.withColumn("cell", F.explode(F.array_distinct("tour")))
        held = tours.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("pbs"))
        coming = visits.select("label", "dim", "cell").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("vbs"))
        grid = save(held.join(coming, ["label", "dim", "cell"]), "grid")
        deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        at = ["label", "dim", "cell"]
        here = tours.withColumn("cell", F.col("home")).join(grid, at).withColumn("pb", deal("pbs")).withColumn("vb", every("vbs"))
        there = visits.withColumn("tour", F.lit(None).cast("array<int>")).join(grid, at).withColumn("vb", deal("vbs")).withColumn("pb", every("pbs"))
        columns = [*at, "pb", "vb", "rep", "n", "embedding", "home", "tour"]
        both = here.select(*columns, F.lit(False).alias("visitor")).union(there.select(*columns, F.lit(True).alias("visitor")))
        keys = [*at, "pb", "vb"]
        both = both.repartition(*keys).sortWithinPartitions(*keys, "visitor")
        found = save(both.mapInArrow(_compare(threshold), "a long, b long, n long"), "found")
        links = found if links is None else links.union(found)
    comps = connected_components(links.filter("b IS NOT NULL"))
    direct = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = points.join(direct, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("usable"))
    out = rows.join(named, ["label", "embedding", "usable"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _tours(shared, kind: str):
    """Rows (label, dim, rep, n, embedding) with home and tour; vectors travel in the type they came in."""

    def run(batches):
        index = Index.__new__(Index)  # of plain values, so that executors need no copy of this package
        index.__dict__.update(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _rows(batch.column("embedding")).astype(np.float32 if kind == "float" else np.float64)
            x = unit(raw)
            home, tour = index.units(index.cells(x)), index.tour(x)
            offsets = pa.array(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "dim", "rep", "n")), pa.ListArray.from_arrays(offsets, pa.array(raw.ravel())), pa.array(home, pa.int32()), pa.array(list(tour.astype(np.int32)), pa.list_(pa.int32()))],
                ["label", "dim", "rep", "n", "embedding", "home", "tour"],
            )

    return run
