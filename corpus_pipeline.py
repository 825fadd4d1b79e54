"""A pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddledger.llm import language, minhash, pieces, quality, templates
from oddledger.session import staged

# below this share of a text's letters no language is taken as that of the text
LANGUAGE_SHARE = 0.5
# near-duplicates: five words, linked from 0.8 on
NEAR = minhash.NearDup(words=5, num=80, den=100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those of which no language holds half."""
    labels, net = language.fit(docs)
    found = language.with_language(docs, labels, net, names=("_lang_pred", "_lang_score"))
    good = found.filter(
        (found["_lang_pred"] != language.UNKNOWN) & (found["_lang_score"] >= LANGUAGE_SHARE)
    )
    return good.select(docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict as good go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    found = quality.with_quality(docs, model, names=("_quality", "_good"))
    return found.filter("_good = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Rows with one doc_id are one document, of which one row stays.  Rows without a doc_id
    stay.
    """
    gone = minhash.near_duplicates(docs, NEAR).filter("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = staged(
        docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1"), "repeated"
    ).select("doc_id")
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    others = kept.join(repeated, "doc_id", "left_anti")
    return others.select(docs.columns).unionByName(single.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark shows go."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, cut with merge-dropout: doc_id, n_chars, ids, n_tokens, lossless."""
    return pieces.encode(docs)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

# models learned here and the vocabulary's merges are beyond SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
