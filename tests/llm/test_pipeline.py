"""The pipeline's stages on made-up tables whose right decisions are known, or told by comparing every pair."""

import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import crowd

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["th", "ing", "er", "and", "o"], "bb": ["ción", "os", "ñ", "que", "a"]}


def test_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns and 0.5 * docs.count() < out.count() <= docs.count(), name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def corpus():
    rng = random.Random(21)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4)))
    item = [word("aa") for _ in range(30)]
    rows = []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        words = [word(lang) for _ in range(rng.randint(20, 80))]
        if i % 8 == 3:
            words[rng.randrange(len(words))] = "moron"
        if i % 20 == 5:
            words[5:5] = item[10:] + item[:10]
        rows.append((i, " ".join(words), lang, "s", len(words)))
    for k in range(40):  # near copies
        i = rng.randrange(160)
        words = rows[i][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = word(rows[i][2])
        rows.append((200 + k, " ".join(words), rows[i][2], "s", len(words)))
    return rows, " ".join(item)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None, "aa", None, None), (901, "", None, "s", 0), (None, "thing another anding", None, None, 3), (902, "!!! 123", None, "s", 1), (3, "theringand thing ander oer", "aa", "t", 4), (3, "theringand thing ander oer", "aa", "t", 4)]


def write(spark, folder, rows, item):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.coalesce(F.col("text").contains("moron"), F.lit(False)).cast("int").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs.withColumn("component_id", F.lit("x")).withColumn("h1", F.lit(1.5)).withColumn("lang_pred", F.lit(True)).withColumn("n_rows", F.lit(0)).withColumn("toxicity", F.array(F.lit(1)))


def test_decisions_match_brute_force(spark, tmp_path):
    rows, item = corpus()
    docs = write(spark, str(tmp_path), rows + ODD, item).drop("n_rows", "lang_pred")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r[0]: r[1] for r in rows}
    step = lambda name, d: stages[name](spark, d, str(tmp_path)).cache()

    clean = step("toxicity", docs)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in texts.items() if "moron" not in t.split()} | {900, 901, 902, None, 3}

    told = step("language_id", clean)
    ids = {r["doc_id"] for r in told.collect()}
    assert not ids & {900, 901, 902} and None in ids and len({r["doc_id"] for r in clean.collect()} - ids) <= 6

    once = step("minhash_near_dedup", told)
    left = {r["doc_id"]: r["text"] for r in told.filter("doc_id IS NOT NULL").orderBy(F.desc("text")).collect()}
    both = told.filter("doc_id IS NOT NULL").select("doc_id", "text").collect()
    sets = []
    for r in both:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = {i: i for i in left}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for x, y in itertools.combinations(range(len(both)), 2):
        shared = len(sets[x] & sets[y])
        if shared and 100 * shared >= 80 * (len(sets[x]) + len(sets[y]) - shared):
            a, b = find(both[x]["doc_id"]), find(both[y]["doc_id"])
            low[max(a, b)] = min(a, b)
    got = [r["doc_id"] for r in once.collect()]
    assert sorted(i for i in got if i is not None) == sorted({find(i) for i in left}) and got.count(None) == 1
    three = [r["text"] for r in once.filter("doc_id = 3").collect()]
    assert three == [] or three == [min(r["text"] for r in both if r["doc_id"] == 3)]

    free = step("benchmark_decontamination", once)
    tokens = item.split()
    seeds = {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}

    def leaked(text):
        w = text.split()
        covered = set()
        for i in range(len(w) - 4):
            if tuple(w[i : i + 5]) in seeds:
                covered |= set(w[i : i + 5])
        return len(covered & set(tokens)) >= 0.5 * len(set(tokens))

    assert sorted(map(repr, (r["doc_id"] for r in free.collect()))) == sorted(repr(r["doc_id"]) for r in once.collect() if not leaked(r["text"]))

    packed = step("packing", free).toPandas()
    assert packed["doc_id"].nunique(dropna=False) == free.select("doc_id").distinct().count()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run_of_empty_and_unlabelled_tables(spark, tmp_path):
    write(spark, str(tmp_path / "none"), [], "")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(i, t, None, None, None) for i, t in enumerate(["one two three", None, "", "one two three"])]
    write(spark, str(tmp_path / "bare"), rows, "no such words at all")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "bare")).collect()} == {0, 1, 2}


def test_clashing_columns_pass_through(spark, tmp_path):
    rows, item = corpus()
    docs = write(spark, str(tmp_path), rows[:60], item)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_near_duplicate_stage_compares_only_what_is_left(spark, monkeypatch):
    compared, dealt = [], corpus_pipeline.minhash.dealt
    monkeypatch.setattr(corpus_pipeline.minhash, "dealt", lambda d, *a: compared.append(d.count()) or dealt(d, *a))
    rows = crowd()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert 0 in kept and 500 < len(kept) < 1000
    assert len(compared) > 2 and max(compared[1:]) < 0.7 * compared[0]  # unlike texts that share a passage are compared once
