"""MinHash near-duplicates by tensored banding.

Two small collections of `tables` sub-keys of `rows` MinHash values each are computed per set; a key of the full
table combines one sub-key of either collection, so that 2 * tables * rows MinHash values serve tables**2 keys of
2 * rows values. With tables=20 and rows=4 a pair of similarity 0.8 shares no key with probability under 0.0001.

Copies with equal sets collapse to their smallest id first. Keys with equal members collapse to one. Then candidates
are verified in steps that each leave fewer: every set with the smallest member of one key; every set that shares a
key with a set of another component with the likeliest of those, round after round; and what is still apart, all
pairs, on full sets inside the tasks. Keys whose members overlap are taken together as one group, so a set is about
one row per group, not one per key. A group is dealt over a grid of blocks, in which sets are 512-byte summaries; no
candidate pair is dropped however large a group is, a task holds one block, and each set sends one pair a block at
most. Texts move only to pairs that a summary cannot rule out. Every link is confirmed on full sets.

Defined results: null or empty texts and texts without words have an empty set and no link; a row with a null id is
linked with nothing and kept; ids are read as longs, so a text id is a null one; rows with equal ids are one document,
whose texts are linked; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import bit_filter, forget, passing, save, save_in_buckets, settled, slices
from webloom.llm.components import connected_components
from webloom.llm.shingles import BASE, linked, mix, shingle_set

CHUNK = 1 << 15  # shingles whose MinHash values are computed at once
BINS = 512
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def summaries(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of BINS bytes for each of n sets: of each bin a digest of its least hashed value, 0 for an empty bin."""
    h = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(n * BINS, _NONE)
    np.minimum.at(least, owner * BINS + (h >> np.uint64(55)).astype(np.int64), h)
    return np.where(least == _NONE, 0, 1 + least % np.uint64(255)).astype(np.uint8).reshape(n, BINS)


def _sketches(k: int, tables: int, rows: int):
    n_hash = 2 * tables * rows

    def run(batches):
        rng = np.random.default_rng(7)
        masks = rng.integers(0, 1 << 63, n_hash, dtype=np.uint64)
        factors = rng.integers(0, 1 << 63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            keys = np.zeros((len(sets), 2 * tables), dtype=np.uint64)
            digests = np.zeros((len(sets), 2), dtype=np.uint64)
            bins = np.zeros((len(sets), BINS), dtype=np.uint8)
            full, at = np.flatnonzero(sizes), 0
            while at < len(full):
                stop, total = at, 0
                while stop < len(full) and (stop == at or total + sizes[full[stop]] <= CHUNK):
                    total += sizes[full[stop]]
                    stop += 1
                ids = full[at:stop]
                values = np.concatenate([sets[i] for i in ids])
                starts = np.concatenate([[0], np.cumsum(sizes[ids])[:-1]])
                digests[ids, 0] = np.add.reduceat(mix(values + BASE), starts)
                digests[ids, 1] = np.add.reduceat(mix(values ^ BASE), starts)
                bins[ids] = summaries(values, np.repeat(np.arange(len(ids)), sizes[ids]), len(ids))
                sub = np.zeros((len(ids), 2 * tables), dtype=np.uint64)
                for h in range(n_hash):
                    low = np.minimum.reduceat((values ^ masks[h]) * factors[h], starts)
                    sub[:, h // rows] = mix(sub[:, h // rows] * BASE + low)
                keys[ids] = sub
                at = stop
            offsets = np.arange(0, tables * len(sets) + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "h1", "h2")),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests[:, 0].view(np.int64)),
                    pa.array(digests[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys[:, :tables].ravel().view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(keys[:, tables:].ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in bins], pa.binary()),
                ],
                ["doc_id", "h1", "h2", "n_shingles", "d1", "d2", "ka", "kb", "bins"],
            )

    return run


def _bytes(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)


def _true(mask: np.ndarray) -> np.ndarray:
    """How many of the BINS places of each row are true: eight byte counters side by side, of at most 64 each."""
    return mask.view(np.uint64).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


def agreement(a: np.ndarray, b: np.ndarray, n1, n2, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of equal bins, whether the similarity can be `percent`) of rows of summaries, n1 and n2 the set sizes.

    The filled bins are a sample of the union without replacement; what is ruled out lies 5.5 standard deviations
    below what a pair of just that similarity shows. Small sets have a bin a shingle, so little is left to chance.
    """
    p = percent / 100
    same, zero = _true(a == b), _true((a | b) == 0)
    filled = np.maximum(BINS - zero, 1)
    share = (same - zero) / filled
    union = np.maximum((n1 + n2) / (1 + p), filled)
    least = p - 5.5 * np.sqrt(p * (1 - p) / filled * (1 - filled / union)) - 1e-9
    return share, (share >= least) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


def _hopeful(percent: int):
    """Of rows (a, b, n1, s1, n2, s2) the pairs that may be similar enough."""

    def run(batches):
        for batch in slices(batches, 1024):
            if batch.num_rows:
                n1, n2 = (batch.column(n).to_numpy() for n in ("n1", "n2"))
                good = agreement(_bytes(batch.column("s1")), _bytes(batch.column("s2")), n1, n2, percent)[1]
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


class _Block:
    """Members that one cell holds, by size, so that those of a similar size are one slice."""

    def __init__(self, percent: int):
        self.percent, self.parts, self.texts, self.ids = percent, [], [], None

    def add(self, ids, c, n, bins, texts=()) -> None:
        self.parts.append((ids, c, n, bins))
        self.texts += texts

    def close(self) -> None:
        if self.ids is None:
            ids, c, n, bins = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(n, kind="stable")
            self.ids, self.c, self.n, self.bins = ids[order], c[order], n[order], np.ascontiguousarray(bins[order])
            self.texts = [self.texts[i] for i in order] if self.texts else []
            self.best, self.who = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)

    def near(self, i: int, c: int, n: int, bins: np.ndarray, below: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places, shares) of held members of other components that may be linked; only smaller ids where `below`."""
        low = np.searchsorted(self.n, -(-self.percent * n // 100), "left")
        high = np.searchsorted(self.n, 100 * n // self.percent, "right")
        some = (self.c[low:high] != c) & ((self.ids[low:high] < i) if below else True)
        if not some.any():
            return np.zeros(0, np.int64), np.zeros(0)
        share, good = agreement(self.bins[low:high], bins, self.n[low:high], n, self.percent)
        at = np.flatnonzero(some & good)
        return at + low, share[at]


def _cells(batches, keys: list[str], rows: int = 256):
    """(key, slice) of sorted rows, each slice of one key."""
    for batch in slices(batches, rows):
        names = list(zip(*(batch.column(x).to_pylist() for x in keys)))
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else [0]
        for start, stop in zip(edges, edges[1:]):
            yield names[start], batch.slice(start, stop - start)


def _best(percent: int):
    """(a, b): for each member of a cell (held ones first) the likeliest member of another component, if any may do."""

    def run(batches):
        at, block = None, None

        def held():
            if block is None or block.ids is None:
                return []
            some = np.flatnonzero(block.best >= 0)
            return list(zip(block.ids[some].tolist(), block.who[some].tolist()))

        send = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])
        for key, part in _cells(batches, ["grp", "hb", "vb"]):
            rows = []
            if key != at:
                rows, at, block = held(), key, _Block(percent)
            ids, c, n, bins = part.column("rep").to_numpy(), part.column("c").to_numpy(), part.column("n").to_numpy(), _bytes(part.column("bins"))
            keep, lone = (part.column(x).to_numpy(zero_copy_only=False) for x in ("held", "lone"))
            if keep.any():
                block.add(ids[keep], c[keep], n[keep], bins[keep])
            for v in np.flatnonzero(~keep) if block.parts else ():
                block.close()
                places, share = block.near(ids[v], c[v], n[v], bins[v], lone[v])
                if len(places):
                    rows.append((int(ids[v]), int(block.ids[places[share.argmax()]])))
                    more = share > block.best[places]
                    block.best[places[more]], block.who[places[more]] = share[more], ids[v]
            if rows:
                yield send(rows)
        if rows := held():
            yield send(rows)

    return run


def _links(k: int, percent: int):
    """Links (a, b) between components in each cell, enough of them to join what the cell joins."""

    def run(batches):
        at, block, sets, root = None, None, {}, {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for key, part in _cells(batches, ["grp", "hb", "vb"]):
            if key != at:
                at, block, sets, root = key, _Block(percent), {}, {}
            ids, c, n, bins = part.column("rep").to_numpy(), part.column("c").to_numpy(), part.column("n").to_numpy(), _bytes(part.column("bins"))
            keep, lone = (part.column(x).to_numpy(zero_copy_only=False) for x in ("held", "lone"))
            texts, a, b = part.column("text").to_pylist(), [], []
            if keep.any():
                block.add(ids[keep], c[keep], n[keep], bins[keep], [t for t, x in zip(texts, keep) if x])
            for v in np.flatnonzero(~keep) if block.parts else ():
                block.close()
                places, share = block.near(ids[v], c[v], n[v], bins[v], lone[v])
                mine = shingle_set(texts[v], k) if len(places) else None
                for i in places[np.argsort(-share, kind="stable")]:
                    one, two = find(int(block.c[i])), find(int(c[v]))
                    if one == two:
                        continue
                    if i not in sets:
                        sets[i] = shingle_set(block.texts[i], k)
                    if linked(sets[i], mine, percent):
                        a.append(int(min(block.ids[i], ids[v])))
                        b.append(int(max(block.ids[i], ids[v])))
                        root[max(one, two)] = min(one, two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def groups_of(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(grp, rep) of the sets that share a key with a set of another component, saved.

    members: (key, hub, rep). A key joins the group of the smallest hub that any of its members has elsewhere, so keys
    of one crowd of similar sets are one group.
    """
    named = members.join(comps.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left")
    named = save(named.select("key", "hub", "rep", F.coalesce("c", "rep").alias("c")), "named")
    split = save(named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"), "split")
    lead = F.min("hub").over(Window.partitionBy("rep"))
    led = save(named.join(split, "key", "left_semi").select("key", "rep", lead.alias("lead")), "led")
    forget(named, split)
    group = save(led.groupBy("key").agg(F.min("lead").alias("grp")), "group")
    out = save(led.join(group, "key").select("grp", "rep").distinct(), "groups")
    forget(led, group)
    return out


def still_open(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(grp, rep, c, lone) of the groups (grp, rep) that hold several components, saved.

    Members outside the component of the group's name are lone.
    """
    named = groups.select("grp", "rep").join(comps.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left")
    named = named.select("grp", "rep", F.coalesce("c", "rep").alias("c"))
    several = named.groupBy("grp").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("grp")
    first = several.join(comps.select(F.col("id").alias("grp"), F.col("component").alias("h")), "grp", "left")
    return save(named.join(first, "grp").select("grp", "rep", "c", (F.col("c") != F.coalesce("h", "grp")).alias("lone")), "open")


def open_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
    """still_open() of groups_of()."""
    return still_open(groups_of(members, comps), comps)


def dealt(rows: DataFrame, block: int, volume: int) -> DataFrame:
    """rows (grp, rep, c, lone, n, ...) dealt over a grid of each group: lone members held in blocks, all as visitors.

    A cell takes about `block` members and `volume` shingles of either kind, held ones first.
    """
    blocks = lambda test: F.ceil(F.greatest(F.count_if(test) / block, F.sum(F.when(test, F.col("n"))) / volume)).cast("int")
    grid = rows.groupBy("grp").agg(blocks(F.col("lone")).alias("hbs"), blocks(F.lit(True)).alias("vbs")).filter("hbs > 0")
    rows = rows.join(grid, "grp")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.filter("lone").withColumn("hb", own("hbs")).withColumn("vb", every("vbs")).withColumn("held", F.lit(True))
    come = rows.withColumn("vb", own("vbs")).withColumn("hb", every("hbs")).withColumn("held", F.lit(False))
    return held.unionByName(come).drop("hbs", "vbs").repartition("grp", "hb", "vb").sortWithinPartitions("grp", "hb", "vb", F.desc("held"))


def _confirm(k: int, percent: int):
    """Rows sorted by (hub, salt, role): a hub's text, then the texts compared with it."""

    def run(batches):
        key, hub = None, None
        for batch in slices(batches):
            a, b = [], []
            for h, salt, i, text in zip(*(batch.column(n).to_pylist() for n in ("hub", "salt", "member", "text"))):
                if (h, salt) != key:
                    key, hub = (h, salt), None
                own = shingle_set(text, k)
                if i is None:
                    hub = own
                elif hub is not None and linked(own, hub, percent):
                    a.append(h)
                    b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirm_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int, most: int = 128) -> DataFrame:
    """The pairs (a, b) whose full shingle sets of `texts` (rep, text) are similar enough, saved.

    Each pair carries the text of `b` to a copy of `a`'s text; pairs with one hub are dealt over groups of about `most`.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("salts"))
    dealt = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("member"))
    hubs = dealt.select("hub", "salt").distinct().withColumn("member", F.lit(None).cast("long"))
    need = save(dealt.withColumn("rep", F.col("member")).union(hubs.withColumn("rep", F.col("hub"))), "need")
    rows = need.join(texts, "rep").select("hub", "salt", "member", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    out = save(rows.mapInArrow(_confirm(k, percent), "a long, b long"), "links")
    forget(need)
    return out


def bodies_of(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, n, bins, text) of the sets that share a key, in buckets by rep: texts move once for all later joins.

    A filter of bounded size keeps nearly all other texts where they are.
    """
    ids = members.select("rep").distinct()
    known = bit_filter(members.select(F.xxhash64("rep")))
    own = reps.select("rep", "h1", "h2", F.col("n_shingles").alias("n"), "bins")
    wanted = save(passing(own, "rep", known).join(ids, "rep", "left_semi"), "wanted")
    texts = passing(docs.withColumnRenamed("doc_id", "rep"), "rep", known).join(wanted, ["rep", "h1", "h2"])
    once = texts.groupBy("rep", "h1", "h2").agg(*(F.first(c).alias(c) for c in ("n", "bins", "text")))  # repeated rows
    out = save_in_buckets(once.select("rep", "n", "bins", "text"), "bodies", "rep")
    forget(wanted)
    return out


def candidate_keys(reps: DataFrame, tables: int) -> DataFrame:
    """(key, hub, rep): keys that several of reps (rep, ka, kb) share, of keys with equal members one; hub is the smallest."""
    # Sub-keys that two sets share, and full keys made of those only.
    sub = reps.select("rep", F.posexplode(F.concat("ka", "kb")).alias("place", "value"))
    shared = sub.groupBy("place", "value").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    left = sub.join(shared, ["place", "value"], "left_semi").groupBy("rep").agg(F.collect_list(F.struct("place", "value")).alias("got"))
    side = lambda test: F.filter("got", test)
    full = left.select(
        "rep",
        F.explode(
            F.flatten(
                F.transform(
                    side(lambda x: x["place"] < tables),
                    lambda x: F.transform(side(lambda y: y["place"] >= tables), lambda y: F.xxhash64(x["place"], x["value"], y["place"], y["value"])),
                )
            )
        ).alias("key"),
    )
    full = save(full, "keys")
    groups = full.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    groups = groups.filter("n > 1").groupBy("n", "hub", "x", "y").agg(F.min("key").alias("key")).select("key", "hub")
    members = save(full.join(groups, "key"), "members")
    forget(full)
    return members


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, tables: int = 20, rows: int = 4, rounds: int = 3, block: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text), whole texts.

    Linked are rows whose distinct k-word shingle sets have 100 * intersection >= percent * union.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    return settled(lambda: _near_duplicates(docs, k, percent, tables, rows, rounds, block), "near-duplicates")


def _near_duplicates(docs: DataFrame, k: int, percent: int, tables: int, rows: int, rounds: int, block: int) -> DataFrame:
    schema = "doc_id long, h1 long, h2 long, n_shingles long, d1 long, d2 long, ka array<long>, kb array<long>, bins binary"
    sketches = save(docs.mapInArrow(_sketches(k, tables, rows), schema), "sketches")
    usable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = usable.groupBy("d1", "d2", "n_shingles").agg(F.min_by(F.struct("h1", "h2", "ka", "kb", "bins"), "doc_id").alias("k"), F.min("doc_id").alias("rep"))
    reps = save(reps.select("rep", "d1", "d2", "n_shingles", "k.*"), "reps")
    shared = candidate_keys(reps, tables)
    # A hub is in each of its keys, so sets that share a key share its hub: one row for each of a hub's sets, not one a key.
    members = save(shared.select(F.col("hub").alias("key"), "hub", "rep").distinct(), "members")
    forget(shared)
    bodies = bodies_of(docs, reps, members)
    size, texts = bodies.select("rep", "n", "bins"), bodies.select("rep", "text")

    # Each set with the smallest member of one key.
    stars = save(members.filter("hub <> rep").groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "stars")
    both = stars.join(size.select(F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("bins").alias("s1")), "a")
    both = both.join(size.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("bins").alias("s2")), "b")
    links = confirm_links(save(both.mapInArrow(_hopeful(percent), "a long, b long"), "hopeful"), texts, k, percent)
    comps = connected_components(links)

    # Each set that is still apart from another of its group with the likeliest; at last those that are left on full sets.
    # Components only merge, so a set that no other component may be linked with leaves its groups for good.
    left = groups_of(members, comps)
    while True:
        apart = still_open(left, comps)
        best = save(dealt(apart.join(size, "rep"), block, 1 << 62).mapInArrow(_best(percent), "a long, b long"), "best")
        if best.isEmpty():
            break
        some = best.select(F.col("a").alias("rep")).union(best.select(F.col("b").alias("rep"))).distinct()
        left = save(apart.join(some, "rep", "left_semi"), "left")
        pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = confirm_links(pairs, texts, k, percent) if rounds else None
        done = found is None or found.isEmpty()
        if done:
            found = save(dealt(left.join(bodies, "rep"), block // 4 or 1, 1 << 20).mapInArrow(_links(k, percent), "a long, b long"), "rest")
            if found.isEmpty():
                break
        links, rounds = links.union(found), rounds - 1
        comps = connected_components(links)
        if done:
            break

    classes = reps.select("d1", "d2", "n_shingles", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
