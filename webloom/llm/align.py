"""Cross-tokenizer alignment by lockstep merging.

A byte-level vocabulary (A) encodes a space and the text, a sentence-piece vocabulary (B) the text, before which it puts
that space itself. Both give the same bytes, so tokens of either are spans of one row of bytes. Two pointers walk over
them: each step links the A and the B token under the pointers, cuts where both end at one byte, and moves the pointer
whose token ends first, or both. One numpy state vector holds the pointers of all documents of a batch and moves them at
once; a finished document leaves the vector. A long document takes part as lanes of at most `LANE` A tokens, each with
its own pointers, so that it needs no more steps than a short one.

How many documents hold a linked pair of ids is counted on Spark, from the distinct pairs of each document. Where
there are at most `most_pairs` pairs, their counts are broadcast to the documents; otherwise the documents' pairs are
joined with them.

B gets texts of more than `LONG` characters in segments, so that its work and memory stay in proportion to the text: it
has no token that runs over a space after a character that is none, so what lies between such spaces has the same tokens
alone as in its text. A vocabulary for which that does not hold gets whole texts.

Defined results: texts that are null or empty, and those whose joined A or B bytes differ from the space and the text
(as U+2581 in a text, which B reads as a space), have no tokens: zeros and an empty `groups_sha256`. Strings of special
tokens inside a text are plain text. Repeated rows and null ids are documents like others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import light_slices, save, settled
from webloom.llm.tokens import WholeTokenizer, token_bytes

LANE = 128
LONG = 1 << 16
_EDGE = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """Two vocabularies, and the ids that they give to texts."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = WholeTokenizer(a_path, ordinary=True), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = token_bytes(a_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)

    def segments(self, text: str) -> list[str]:
        """The text in segments of about LONG characters, each without the space that it begins with and that B puts back."""
        out, at = [], 0
        while self.apart and (edge := _EDGE.search(text, at + LONG)):
            out.append(text[at : edge.start()])
            at = edge.start() + 1
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each text; none where their bytes are not those of a space and the text."""
        parts = [self.segments(t) if t else [] for t in texts]
        found = iter(self.b.encode([p for own in parts for p in own], num_threads=1))
        none = np.empty(0, np.int64)
        out = []
        for text, own in zip(texts, parts):
            if not text:
                out.append((none, none))
                continue
            a, b = self.a.encode(" " + text), [i for _ in own for i in next(found)]
            whole = f" {text}".encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else (none, none))
        return out


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether both end there) of every link, lane by lane in order.

    Lane k begins at A token i[k] and B token j[k] and ends before A token stop[k].
    """
    lane, lived, steps = np.arange(len(i)), np.zeros(len(i), np.int64), []
    while len(lane):
        ea, eb = a_ends[i], b_ends[j]
        steps.append((lane, i, j, ea == eb))
        i, j = i + (ea <= eb), j + (eb <= ea)
        on = i < stop
        if not on.all():
            lived[lane[~on]] = len(steps)
            lane, i, j, stop = lane[on], i[on], j[on], stop[on]
    first = np.cumsum(lived) - lived
    total = int(lived.sum())
    out = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, bool)
    for step, (lane, *found) in enumerate(steps):
        at = first[lane] + step
        for to, values in zip(out, found):
            to[at] = values
    return out


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, and which of them are not leading zeros; a last column is for a separator."""
    wide = len(str(n - 1))
    powers = 10 ** np.arange(wide - 1, -1, -1)
    numbers = np.arange(n)[:, None]
    digits = np.zeros((n, wide + 1), np.uint8)
    digits[:, :wide] = numbers // powers % 10 + ord("0")
    used = np.ones((n, wide + 1), bool)
    used[:, : wide - 1] = numbers >= powers[:-1]
    return digits, used


class Aligned:
    """Alignment of a batch of encoded texts."""

    def __init__(self, encoded: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.docs = len(encoded)
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in encoded)]) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        last = np.cumsum(self.n_a)
        lanes = -(-self.n_a // LANE)
        own = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)  # a lane's number in its document
        i = np.repeat(last - self.n_a, lanes) + LANE * own
        stop = np.minimum(i + LANE, np.repeat(last, lanes))
        j = np.searchsorted(b_ends, a_ends[i] - a_sizes[self.a[i]], "right")
        self.link_a, self.link_b, self.cut = lockstep(a_ends, b_ends, i, j, stop)
        self.doc = np.repeat(np.arange(self.docs), self.n_a)[self.link_a]
        self.n_links = np.bincount(self.doc, minlength=self.docs)
        self.n_groups = np.bincount(self.doc[self.cut], minlength=self.docs)

    def pairs(self, vocab_a: int, vocab_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id * vocab_b + B id, times) of the distinct pairs of each document, in that order."""
        every = vocab_a * vocab_b
        key, n = np.unique(self.doc * every + self.a[self.link_a] * vocab_b + self.b[self.link_b], return_counts=True)
        return key // every, key % every, n

    def groups(self, digits: np.ndarray, used: np.ndarray) -> list[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of each document, as bytes."""
        a_cut, b_cut = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_cut[self.link_a[self.cut]] = b_cut[self.link_b[self.cut]] = True
        of_a, of_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut  # the group of each token
        total = int(a_cut.sum())
        before = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=total))])
        until = np.cumsum(np.bincount(of_a, minlength=total))
        a_at, b_at = np.arange(len(self.a)) + before[of_a], np.arange(len(self.b)) + (until[of_b] if total else 0)
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        marks[a_at], marks[b_at] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
        text = digits[ids]
        text[:, -1] = marks
        kept = used[ids]
        ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        whole = memoryview(text[kept])
        return [whole[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]  # without the last separator


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """Rows of docs (doc_id, text) with n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times: distinct linked ids.

    A pair is the A id times the size of vocabulary B, plus the B id. With `groups` the column groups holds the
    aligned ids themselves.
    """
    vocab_a, vocab_b = vocab_sizes(a_path, b_path)
    kind, key = docs.schema["doc_id"].dataType.simpleString(), "int" if vocab_a * vocab_b < 1 << 31 else "long"

    def run(batches):
        both = Pair(a_path, b_path)
        a_sizes, b_sizes = (np.array([len(x) for x in known], np.int64) for known in (both.a_bytes, both.b_bytes))
        digits, used = _digits(max(vocab_a, vocab_b))
        for batch in light_slices(batches, "text"):
            found = Aligned(both.encode(batch.column("text").to_pylist()), a_sizes, b_sizes)
            doc, pair, times = found.pairs(vocab_a, vocab_b)
            offsets = pa.array(np.searchsorted(doc, np.arange(found.docs + 1)), pa.int32())
            shown = found.groups(digits, used)
            arrays = {
                "doc_id": batch.column("doc_id"),
                **{name: pa.array(getattr(found, name), pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")},
                "groups_sha256": pa.array([hashlib.sha256(x).hexdigest() if len(x) else "" for x in shown], pa.string()),
                "pairs": pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int32() if key == "int" else pa.int64())),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
            }
            if groups:
                arrays["groups"] = pa.array([bytes(x).decode() for x in shown], pa.string())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{key}>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", groups string" * groups)


def vocab_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    import sentencepiece

    return len(token_bytes(a_path)), sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()


def pair_counts(aligned: DataFrame, vocab_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold a pair, and whether no other pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.expr(f"pair div {vocab_b}"))
    counts = save(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = 1 << 22) -> DataFrame:
    """Each document's n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, from counts over all documents."""
    return settled(lambda: _link_counts(docs, a_path, b_path, most_pairs), "aligned")


def _link_counts(docs: DataFrame, a_path: str, b_path: str, most_pairs: int) -> DataFrame:
    spark = docs.sparkSession
    aligned = save(align(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "pairs")
    counts = save(pair_counts(aligned, vocab_sizes(a_path, b_path)[1]), "counted")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.count() > most_pairs:
        links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = aligned.drop("pairs", "times").join(sums, "row", "left")
        return out.select(*plain, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))
    table = counts.toArrow().sort_by("pair")  # at most most_pairs rows of 17 bytes
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.searchsorted(pairs, lists.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ends])
            arrays = [*(batch.column(c) for c in plain), pa.array(sums(times * best[at]), pa.int64()), pa.array(sums(times * n[at]), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*plain, "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(plain).schema.fields)
    return aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long")
