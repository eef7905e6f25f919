"""Importance resampling against zlib, plain Python and NumPy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from webloom.llm import resample

ODD = [None, "", "   ", "!!!", "One", "ÀÉ éà x", "a" * 5000 + " b", "日本語 🙂 zwei", "\x00 nul\x00", "A-b_C9", "é" * 600, "w" * 1024, "w" * 2048 + "x", "x y " * 30]


def texts(n=60):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon ein zwei drei uno dos tres été À1 x9".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [*ODD, *made, *made[:4]]


def brute(docs, target, longest, percent, least, buckets):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))

    def held(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own = {i: held(t) for i, t in docs}
    s, t = Counter(b for x in own.values() for b in x), Counter(b for x in target for b in held(x))
    total_s, total_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = {}
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own[i])
        out[i] = [len(own[i]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((i for i, text in docs if len(words(text)) >= least), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(fit[: len(fit) * percent // 100]):
        out[i][3] = k + 1
    return out


@pytest.mark.parametrize("longest,percent,least,buckets", [(1, 10, 20, 10_000), (3, 50, 0, 97)])
def test_draws_match_brute_force(spark, longest, percent, least, buckets):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(5)
    target = spark.createDataFrame([(t,) for t in ["alpha beta gamma uno", None, "été x9 zwei", ""]], "text string")
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in resample.resample(docs, target, percent, least, "2024", longest, buckets).collect()}
    assert got == brute(rows, [r["text"] for r in target.collect()], longest, percent, least, buckets)
    assert any(x[3] for x in got.values())


def test_crcs_of_every_length():
    rng = np.random.default_rng(1)
    lengths = np.array([*range(40), 0, 7, 7, 1023, 1024, 1025, 2048, 2049, 3000, 10_240])
    data = rng.integers(0, 256, lengths.sum()).astype(np.uint8)
    starts = np.cumsum(lengths) - lengths
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert resample.crc32s(data, starts, lengths).tolist() == want == resample.crc32s(data, starts, lengths, rows=3).tolist()


def test_a_word_of_millions_of_bytes():
    word = b"ab" * 2_000_000
    doc, bucket, n = resample.features([word, None, word + b" c"], 1, 10_000)
    assert n.tolist() == [1, 0, 2] and bucket.tolist() == [zlib.crc32(word) % 10_000] * 2 + [zlib.crc32(b"c") % 10_000]


def test_ties_null_ids_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert resample.resample(none, target).collect() == []
    docs = spark.createDataFrame([(1, "x y " * 20)] * 6 + [(None, "x y " * 20)] * 4, "doc_id long, text string")
    out = resample.resample(docs, target, percent=50).collect()
    assert len(out) == 10 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5]
    assert len({r["doc_id"] for r in out if r["rank"]}) == 1 or sorted(r["score"] for r in out)[5] > 0


def test_no_task_ranks_all_rows(spark):
    """A third of the rows have one id and one text, so one score."""
    rows = [(i if i % 3 else 0, f"w{i % 7} " * 20 if i % 3 else "same " * 20) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = resample.resample(docs, docs.select("text"), percent=100)
    ranked = sorted((r["rank"], r["score"]) for r in out.collect())
    assert [r for r, _ in ranked] == list(range(1, 601)) and [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True)
