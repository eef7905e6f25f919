"""Cross-tokenizer alignment against whole-text encoding and a merge in plain Python."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import align
from webloom.llm.queries import QUERIES, piece_path, tokenizer_path

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "   ", "one", " lead", "trail ", "two  blanks", "tab\t x \n y\n\n z", "a\n b", "x　 y", "\x1c a\x85 b", "<s> </s><unk> <|endoftext|>", "▁ mark", "re▁al",
    "日本語 🙂 é é ﬁ", "\x00 nul", "don't we'll", "x" * 3000, "ab " * 700, " " * 400, "naïve café " * 90, "12345 67890,000.5",
]


def brute(texts):
    """(n_a, n_b, groups text, links) of each text, by encoding it whole and comparing all ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=piece_path())
    a.encode_special_tokens = True
    plain = [x for x in range(256) if chr(x).isprintable() and x not in (32, 160, 173)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, "", []))
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(x) != (" " + text).encode() for x in own):
            out.append((0, 0, "", []))
            continue
        spans = [list(zip(np.cumsum([0, *map(len, x)]).tolist(), np.cumsum([*map(len, x)]).tolist())) for x in own]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda k, lo, hi: ",".join(str(i) for i, (s, e) in zip(ids[k], spans[k]) if lo <= s and e <= hi)
        groups = ";".join(f"{inside(0, lo, hi)}|{inside(1, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        links = [(i, j) for i, (s, e) in zip(ids[0], spans[0]) for j, (t, f) in zip(ids[1], spans[1]) if s < f and t < e]
        out.append((len(ids[0]), len(ids[1]), groups, links))
    return out


def counted(found):
    held, most = Counter(), Counter()
    for *_, links in found:
        held.update(set(links))
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (n_a, n_b, len(groups.split(";")) if groups else 0, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in found
    ]


def some(n=40):
    rng = random.Random(4)
    letters = "abcdefghij éß日▁\n\t .,'0123<>|"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    return [*ODD, *made, *made[:5], *ODD]


@pytest.mark.parametrize("most_pairs", [1 << 22, 3])
def test_links_match_brute_force(spark, most_pairs):
    texts = some()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string")
    out = align.link_counts(docs, tokenizer_path(), piece_path(), most_pairs).orderBy("doc_id").collect()
    got = [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out]
    assert got == counted(brute(texts))
    groups = align.align(docs, tokenizer_path(), piece_path(), groups=True).orderBy("doc_id").select("groups").collect()
    assert [r["groups"] for r in groups] == [x[2] for x in brute(texts)]


def test_lanes_change_nothing(monkeypatch):
    texts = ["ab cde fgh " * 80, *some(10)]
    both = align.Pair(tokenizer_path(), piece_path())
    sizes = [np.array([len(x) for x in known], np.int64) for known in (both.a_bytes, both.b_bytes)]
    out = []
    for lane in (1, 3, 10_000):
        monkeypatch.setattr(align, "LANE", lane)
        a = align.Aligned(both.encode(texts), *sizes)
        out.append((a.link_a.tolist(), a.link_b.tolist(), a.cut.tolist(), a.n_groups.tolist()))
    assert out[0] == out[1] == out[2]


def test_segments_encode_as_whole_texts(monkeypatch):
    whole, both = align.Pair(tokenizer_path(), piece_path()), align.Pair(tokenizer_path(), piece_path())
    texts = [*some(), "word  and  blanks " * 50, "a\n b\t c " * 50]
    want = [(a.tolist(), b.tolist()) for a, b in whole.encode(texts)]
    for long in (0, 1, 7, 40):
        monkeypatch.setattr(align, "LONG", long)
        assert [(a.tolist(), b.tolist()) for a, b in both.encode(texts)] == want
    assert len(both.segments("some more words " * 40)) > 10


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.link_counts(none, tokenizer_path(), piece_path()).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    out = align.link_counts(odd, tokenizer_path(), piece_path()).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in out) == [(0, 0, 0), (0, 2, 6), (3, 2, 6), (3, 2, 6)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_links_of_given_documents(spark):
    """Every 20th document against the merge in plain Python; the counts over all documents against their sum."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    rows = docs.filter("doc_id % 20 = 0 AND length(text) < 5000").collect()
    for r, (n_a, n_b, groups, links) in zip(rows, brute([r["text"] for r in rows])):
        got = out[r["doc_id"]]
        assert (got["n_a"], got["n_b"], got["n_links"]) == (n_a, n_b, len(links))
        assert got["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert len(out) == docs.count()
    pairs = align.align(docs, tokenizer_path(), piece_path())
    per_doc = pairs.select("doc_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("doc_id", "x.*").toPandas()
    n = per_doc.groupby("pairs")["doc_id"].transform("count")
    per_doc["sum"] = n * per_doc["times"]
    best = n.groupby(per_doc["pairs"] // 32000).transform("max") == n
    per_doc["best"] = per_doc["times"].where(best, 0)
    want = per_doc.groupby("doc_id")[["sum", "best"]].sum()
    assert all((got["count_sum"], got["n_best"]) == ((want["sum"][i], want["best"][i]) if i in want.index else (0, 0)) for i, got in out.items())
