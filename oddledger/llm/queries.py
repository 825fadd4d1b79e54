"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddledger.llm import (
    counts,
    entropy,
    html,
    importance,
    language,
    lines,
    minhash,
    pieces,
    quality,
    spots,
    templates,
    warc,
    whiten,
)
from oddledger.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op6_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spots.fingerprint(_table(spark, folder, "documents"))


def op7_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.count_tokens(_table(spark, folder, "documents"))


def op8_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(_table(spark, folder, "documents"))


def op2_mincut(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


def op3_bigru(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op4_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Target documents are those that ``labels`` marks as good."""
    good = _table(spark, folder, "labels").filter("quality = 1")
    return entropy.score(_table(spark, folder, "documents"), good)


def op5_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.decontaminate(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def op10_archive(spark: SparkSession, folder: str) -> DataFrame:
    return warc.index(warc.write(_table(spark, folder, "pages")), spark)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """A deviation too large for a long is null here."""
    found = whiten.whiten(_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_lines(_table(spark, folder, "documents"))
    kept = F.sha2(F.col("kept").cast("binary"), 256)
    return found.withColumn("kept_sha256", kept).drop("kept")


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of ``benchmark`` are the target."""
    found = importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("n_words")


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_mincut": op2_mincut,
    "op3_bigru": op3_bigru,
    "op4_entropy": op4_entropy,
    "op5_templates": op5_templates,
    "op6_spotsigs": op6_spotsigs,
    "op7_counts": op7_counts,
    "op8_boosting": op8_boosting,
    "op9_minhash": op9_minhash,
    "op10_archive": op10_archive,
    "op11_whitening": op11_whitening,
    "op12_lines": op12_lines,
    "op13_importance": op13_importance,
}
