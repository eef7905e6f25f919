"""Importance resampling towards a target distribution, over hashed runs of words.

A text's features are all runs of 1 to `longest` consecutive words, joined by one space, repeats counted; a feature's
bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`. A bucket's gain is the smoothed log-ratio of its shares of the
target's and of the documents' features. A document's weight is the sum of gains over its features; with Gumbel noise
that follows from its id it is a score, and the highest scores are a sample drawn without replacement.

Buckets are computed for the distinct features of a batch at once: features of equal length are the rows of a
two-dimensional byte matrix, all CRCs advance column by column, and the buckets are scattered back to the places of the
features. Of a feature of at least `BLOCK` bytes the columns are blocks: what is left over starts the CRC, whole blocks
are rows of one matrix, and their CRCs are folded in order by the linear map that `BLOCK` zero bytes are.

Counts of buckets are summed in each task before they are shuffled. Ranks come from a sort by ranges of scores and from
the sizes of the ranges, so that no task sees all rows.

Defined results: null and empty texts have no feature and weight 0, and may be drawn only if `least_words` is 0; a null
id reads as no text in the noise and comes after others of its score; rows that share an id and a score come in the
order of their weights, then of their places in the input; repeated rows count and rank one by one; without any document
or without a target text the gains are those of the smoothing alone; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import light_slices, save, settled

BLOCK = 1024
ONES = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    """The register after each value of a byte, from zero."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1)
    return r.astype(np.uint32)


TABLE = _table()
# Bytes of words: digits, lower-case letters, and all of characters beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[ord("0") : ord("9") + 1] = INSIDE[ord("a") : ord("z") + 1] = INSIDE[0x80:] = True


def _columns(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Registers after the bytes of their rows."""
    for byte in matrix.T:
        register = TABLE[(register ^ byte) & 0xFF] ^ (register >> np.uint32(8))
    return register


def _over_block() -> list[np.ndarray]:
    """For each byte of a register, what it becomes over a block of zero bytes."""
    zeros = np.zeros((256, BLOCK), np.uint8)
    return [_columns(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), zeros) for k in range(4)]


def crc32s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: int = 4096) -> np.ndarray:
    """CRC-32 of the pieces of `data`, those of one length at once, at most `rows` of them."""
    out = np.full(len(starts), ONES)
    heads, blocks = lengths % BLOCK, lengths // BLOCK
    order = np.argsort(heads, kind="stable")
    edges = np.flatnonzero(np.diff(heads[order], prepend=-1, append=BLOCK))
    for start, stop in zip(edges[:-1], edges[1:]):
        for at in range(start, stop, rows):
            one = order[at : min(at + rows, stop)]
            out[one] = _columns(out[one], data[starts[one][:, None] + np.arange(heads[one[0]])])
    long = np.flatnonzero(blocks)
    if len(long):
        n = blocks[long]
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(starts[long] + heads[long], n) + BLOCK * own
        found = np.concatenate([_columns(np.zeros(len(f), np.uint32), data[f[:, None] + np.arange(BLOCK)]) for f in np.split(first, range(rows, len(first), rows))])
        over, begins = _over_block(), np.cumsum(n) - n
        for step in range(int(n.max())):
            on = n > step
            r = out[long[on]]
            moved = over[0][r & 0xFF] ^ over[1][r >> np.uint32(8) & 0xFF] ^ over[2][r >> np.uint32(16) & 0xFF] ^ over[3][r >> np.uint32(24)]
            out[long[on]] = moved ^ found[begins[on] + step]
    return out ^ ONES


def _distinct(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each piece the number of its distinct feature, CRC-32 of each distinct feature) of pieces that fill `data`."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    known = coded.dictionary
    ends = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1]
    held = np.frombuffer(known.buffers()[2], np.uint8) if known.buffers()[2] else np.empty(0, np.uint8)
    return coded.indices.to_numpy(), crc32s(held, ends[:-1], np.diff(ends))


def features(texts: list[bytes | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of the texts, and how many words each text has."""
    values = [t or b"" for t in texts]
    buffer = np.frombuffer(b"\x00".join([*values, b""]).lower(), np.uint8)  # bytes.lower() changes A-Z only
    inside = INSIDE[buffer]
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    sizes = ends - starts
    doc = np.searchsorted(np.cumsum([len(v) + 1 for v in values]), starts, "right") if len(values) else starts
    docs, found = [], []
    for k in range(1, longest + 1):
        if len(starts) < k:
            break
        if k == 1:
            of, data, lengths = doc, buffer[inside], sizes
        else:
            keep = inside.copy()
            keep[ends] = True  # the byte after a word, read as the space between words
            spaced = np.where(inside, buffer, ord(" ")).astype(np.uint8)[keep]
            begins = np.cumsum(sizes + 1) - (sizes + 1)
            last = len(starts) - k + 1
            same = doc[:last] == doc[k - 1 :]
            of, first = doc[:last][same], begins[:last][same]
            lengths = (begins[k - 1 :] + sizes[k - 1 :])[same] - first
            data = spaced[np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        which, crc = _distinct(data, lengths)
        docs.append(of)
        found.append((crc % np.uint32(buckets)).astype(np.int64)[which])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *found]), np.bincount(doc, minlength=len(values))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of the texts each bucket holds; at most `buckets` rows leave a task and reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in light_slices(batches, "text"):
            total += np.bincount(features(_texts(batch), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log-ratio of each bucket's smoothed shares, rounded down."""
    s, t, n = docs.astype(np.float64), target.astype(np.float64), len(docs)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    kind, buckets = docs.schema["doc_id"].dataType.simpleString(), len(gain)

    def run(batches):
        for batch in light_slices(batches, "text"):
            doc, bucket, words = features(_texts(batch), longest, buckets)
            weight = np.bincount(doc, weights=gain[bucket], minlength=batch.num_rows)  # whole numbers, exact in doubles
            n = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of docs (doc_id, text) towards the texts of target (text).

    Of the documents with at least `least_words` words `percent` of a hundred, rounded down, are drawn and have a rank.
    """
    return settled(lambda: _resample(docs, target, percent, least_words, seed, longest, buckets), "resampled")


def _resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int, seed: str, longest: int, buckets: int) -> DataFrame:
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise)
    scored = save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("row")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(fit.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = dict(ranged.groupBy("part").agg(F.count("*")).collect())  # at most n rows
    rows, total = [], 0
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    before = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = ranged.join(before, "part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").union(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
