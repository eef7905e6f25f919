"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is its lower-cased UTF-8 bytes with every non-letter ASCII byte read as a word boundary. Its features are all
byte 3-grams and 4-grams that have no boundary inside, hashed into a table of embeddings; their mean goes through a
linear layer and a softmax whose temperature is set on texts kept out of training. A text is rejected when the best
class has less than the threshold found there.

Defined results: `und` with score 0 for a null text or one without a letter; a text whose words are too short for any
feature gets the class of the prior; repeated rows get equal results; without any labelled text every text is `und`
with score 0 and none is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import forget, give_back, save, slices

BITS = 16
SLICE = 1 << 20  # bytes that are held as features at once


def _byte_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if b >= 0x80 or chr(b).isalpha():
            table[b] = ord(chr(b).lower()) if b < 0x80 else b
    return table


BYTES = _byte_table()


def features(text: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Hashed subwords of a text that begin at its padded places start to stop, the whole text's by default."""
    n = len(text) + 2
    stop = n if stop is None else min(stop, n)
    skip = min(start, 1)  # the byte before tells capital letters
    low, high = start - skip, min(n, stop + 3)
    raw = np.frombuffer(b" " * (low == 0) + text[max(0, low - 1) : high - 1] + b" " * (high == n), dtype=np.uint8)
    found = BYTES[raw]
    upper = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
    found[1:][upper] += 0x20  # capital letters of the Latin-1 block
    c = found[skip:].astype(np.uint32)
    inner, places = c != 0, stop - start
    three = (c[:-2] << 16 | c[1:-1] << 8 | c[2:])[:places][inner[1:-1][:places]]
    four = ((c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:])[:places][(inner[1:-2] & inner[2:-1])[:places]]
    return np.concatenate([(three * np.uint32(2654435761)) >> np.uint32(32 - BITS), ((four * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)])


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # embedding of each hashed subword
    out: np.ndarray  # logit that each of its components adds to each class
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for start in range(0, len(text) + 2, SLICE):
            f = features(text, start, start + SLICE)
            total += self.table[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        z = (total / max(n, 1) @ self.out + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(class or und, calibrated probability, rejected); without any class und, and nothing to reject by."""
        if not self.classes:
            return "und", 0.0, False
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        p = self.probabilities(text.encode("utf-8", "replace"))
        best = int(p.argmax())
        return self.classes[best], float(p[best]), bool(p[best] < self.threshold)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(subwords, their shares) of a whole text, slice by slice."""
    data = text.encode("utf-8", "replace")
    n = np.zeros(2 << BITS, np.int64)
    for start in range(0, len(data) + 2, SLICE):
        n += np.bincount(features(data, start, start + SLICE), minlength=2 << BITS)
    some = np.flatnonzero(n)
    return some.astype("<u4"), (n[some] / max(n.sum(), 1)).astype("<f4")


def windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """counted() of the whole text and of a few of its passages of 1 to 60 words, so that short texts are learned too."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    words, parts = text.split(), [text]
    for _ in range(4):
        n = int(rng.integers(1, 61))
        at = int(rng.integers(0, max(1, len(words) - n)))
        parts.append(" ".join(words[at : at + n]))
    return [x for x in map(counted, parts) if len(x[0])]


def _windows(batches):
    """(lang, h, size, ids, shares) of the windows of each text, numbers as bytes."""
    for batch in slices(batches):
        found = [windows(t) for t in batch.column("text").to_pylist()]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        some = batch.take(pa.array(rows))
        flat = [w for x in found for w in x]
        size = pa.array([len(u) for u, _ in flat], pa.int64())
        yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("h"), size, *(pa.array([w[k].tobytes() for w in flat], pa.binary()) for k in (0, 1))], ["lang", "h", "size", "ids", "shares"])


def train(rows: list[tuple[str, list]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 2, reject_quantile: float = 0.001) -> Model:
    """Fit on (lang, windows) rows, windows as of windows(); every fifth text of a language sets the temperature and the rejection threshold instead.

    Without any row the model has no class.
    """
    rng = np.random.default_rng(seed)
    classes = sorted({lang for lang, _ in rows})
    index = {c: i for i, c in enumerate(classes)}
    sets: tuple[list, list] = ([], [])
    seen = Counter()
    for lang, parts in rows:
        seen[lang] += 1
        for u, n in parts:
            sets[seen[lang] % 5 == 0].append((u, n, index[lang]))
    learn, held = sets[0] or sets[1], sets[1] or sets[0]
    E = (rng.random((2 << BITS, dim), dtype=np.float32) - 0.5) / dim
    W, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    if not learn:
        return Model(classes, E, W.astype(np.float64), bias.astype(np.float64))
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            u, share, y = learn[k]
            lr, done = rate * (1 - done / steps), done + 1
            h = share @ E[u]
            z = h @ W + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = W @ g
            W -= lr * np.outer(h, g)
            bias -= 0.1 * lr * g
            E[u] -= (lr * 20 * share)[:, None] * back
    few = len(classes) <= dim  # then one table of logits is smaller
    model = Model(classes, E @ W if few else E, np.eye(len(classes)) if few else W.astype(np.float64), bias.astype(np.float64))
    logits = np.array([share @ model.table[u] @ model.out + bias for u, share, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
    z = logits / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    # Reject below what all but the given share of rightly classified held-out texts reach.
    model.threshold = float(right[int(reject_quantile * len(right))]) if len(right) else 0.0
    return model


def fit(labelled: DataFrame, max_rows: int = 3_000, least: int = 10, max_features: int = 8_000_000, max_languages: int = 2_000, **options) -> Model:
    """Train on rows (doc_id, text, lang): about `max_rows` at most, or `least` a language, dealt evenly over all languages.

    Repeated rows count once. Features of whole texts are counted in tasks; what reaches the driver are the counts, of
    at most about `max_features` subwords: of a language's sampled texts, in the order of their hashes, as many as fit
    in its share, and `least` in any case. A model has a column for each language; more than `max_languages` are an error.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(2)).alias("h"))
    totals = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(max_languages + 1).collect()
    if not totals:
        return train([])
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    share = max(least, max_rows // len(totals))
    rates = usable.sparkSession.createDataFrame([(r["lang"], int(1_000_003 * min(1.0, share / max(1, r["n"])))) for r in totals], "lang string, rate int")
    drawn = usable.join(F.broadcast(rates), "lang").filter(F.pmod("h", F.lit(1_000_003)) < F.col("rate"))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))
    made = save(drawn.mapInArrow(_windows, "lang string, h long, size long, ids binary, shares binary"), "lang-windows")
    texts = made.groupBy("lang", "h").agg(F.sum("size").alias("size"))  # a row for each sampled text
    order = Window.partitionBy("lang").orderBy("h")
    texts = texts.withColumn("upto", F.sum("size").over(order)).withColumn("k", F.row_number().over(order))
    fit_in = texts.filter((F.col("k") <= least) | (F.col("upto") <= max_features // len(totals))).select("lang", "h")
    found = made.join(F.broadcast(fit_in), ["lang", "h"]).orderBy("lang", "h", "size", "ids").toArrow()
    forget(made)
    numbers = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
    rows: list[tuple[str, list]] = []
    last = None
    for lang, h, u, n in zip(found.column("lang").to_pylist(), found.column("h").to_pylist(), found.column("ids"), found.column("shares")):
        if (lang, h) != last:
            rows.append((lang, []))
            last = lang, h
        rows[-1][1].append((numbers(u, "<u4"), numbers(n, "<f4")))
    model = train(rows, **options)
    del found, rows
    give_back()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus lang_pred, lang_score and lang_rejected, from whole texts. Existing columns of these names are replaced."""
    spark = docs.sparkSession
    # Plain values, so that executors need no copy of this package; their size is fixed: 2**17 subwords by at most `dim`.
    shared = spark.sparkContext.broadcast([getattr(model, f.name) for f in fields(Model)])

    def run(batches):
        model = Model(*shared.value)
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            new = {"lang_pred": pa.array([x[0] for x in found], pa.string()), "lang_score": pa.array([x[1] for x in found], pa.float64()), "lang_rejected": pa.array([x[2] for x in found], pa.bool_())}
            arrays = {n: batch.column(n) for n in batch.schema.names} | new
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    kept = docs.drop("lang_pred", "lang_score", "lang_rejected")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, lang_score double, lang_rejected boolean")
