"""A corpus pipeline: toxicity, language ID, near-duplicates, benchmark decontamination, packing.

Nulls, odd texts and extra columns go through as the operators say: a null or empty text is not toxic, is of no known
language and so goes in the second stage, unless nothing is labelled. Rows without a doc_id are kept by every stage.
Of rows that share a doc_id one stays in the third stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, langid, minhash, packing, toxicity
from webloom.llm.common import forget, out_of_the_way, settled, table
from webloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half; the lexicon is learned from the labelled documents."""
    source = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(source, table(spark, sf_dir, "labels"))
    return out_of_the_way(docs, ["toxicity", "toxic_matches"], lambda d: toxicity.score(d, lexicon).filter("toxicity < 0.5"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model is learned from the documents' own labels."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    return out_of_the_way(docs, ["lang_pred", "lang_score", "lang_rejected"], lambda d: langid.identify(d, model).filter("NOT lang_rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows that share that doc_id the one with the smallest text stays, nulls first; of those with one text, any of
    the rows that are first by a hash of their other columns.
    """
    found = minhash.near_duplicates(docs, k=5, percent=80).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n_rows"))

    def once(d: DataFrame) -> DataFrame:
        kept = d.join(found, "doc_id")
        others = [f"`{f.name}`" for f in d.schema.fields if f.name != "text" and f.dataType.typeName() not in ("map", "variant")]
        first = F.min_by(F.struct(*(f"`{c}`" for c in d.columns)), F.struct("text", F.xxhash64(*others)))
        repeated = kept.filter("n_rows > 1").groupBy("doc_id").agg(first.alias("row")).select("row.*")
        return kept.filter("n_rows = 1").select(d.columns).union(repeated).union(d.filter("doc_id IS NULL"))

    return out_of_the_way(docs, ["n_rows", "row"], once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item is leaked."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]
#: Learned models, MinHash and tiling cannot be written in SQL; tests/llm/test_pipeline.py compares what the stages
#: decide with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023  called at once
        if name != STAGES[0][0]:
            forget(before)
    return docs
