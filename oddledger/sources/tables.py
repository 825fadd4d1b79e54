"""Stored tables: transactions by upload, scores and rule flags by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddledger.operators.detectors.weekend import RULES
from oddledger.schema import DERIVED_FIELDS, DERIVED_SCHEMA, TXN_SCHEMA


def core_columns(df: DataFrame) -> DataFrame:
    """All columns of the transaction schema with their types, absent ones as NULL,
    so that every upload is stored alike."""
    core = {
        f.name: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType)
        for f in TXN_SCHEMA
    }
    return df.withColumns(core)


def pack_derived(df: DataFrame) -> DataFrame:
    """Derived fields into one JSON column, as stored."""
    derived = [c for c in DERIVED_FIELDS if c in df.columns]
    if not derived:
        return df
    return df.withColumn("processed_data", F.to_json(F.struct(*derived))).drop(*derived)


def unpack_derived(df: DataFrame) -> DataFrame:
    fields = F.from_json("processed_data", DERIVED_SCHEMA)
    return df.withColumn("_p", fields).select(
        *[c for c in df.columns if c != "processed_data"], "_p.*"
    )


def _overwrite(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``; a retried job stores once.

    Rebalancing gives full-size files and splits a large partition over tasks.
    """
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """A stored table whose partition values are text as written (``007`` stays ``007``)."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == partition else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_transactions(df: DataFrame, path: str) -> None:
    """S7"""
    _overwrite(pack_derived(core_columns(df)), path, "upload_id")


def load_transactions(spark: SparkSession, path: str, upload_id: str | None = None) -> DataFrame:
    """One upload is one partition; other partitions are not listed."""
    df = _stored(spark, path, "upload_id")
    if upload_id is not None:
        df = df.filter(F.col("upload_id") == upload_id)
    return unpack_derived(df) if "processed_data" in df.columns else df


def score_rows(scores: DataFrame, run_id: str) -> DataFrame:
    """Scores in stored form; a z-score has no bound, so the score stays a double."""
    return scores.select(
        "transaction_id",
        F.lit(run_id).alias("run_id"),
        "algorithm_type",
        "algorithm_name",
        F.col("score").cast("double").alias("score"),
        F.col("confidence").cast("decimal(5,4)").alias("confidence"),
        "metadata",
    )


def write_scores(scores: DataFrame, path: str, run_id: str) -> None:
    """S8"""
    _overwrite(score_rows(scores, run_id), path, "run_id")


def rule_flags(weekend_result: DataFrame, run_id: str) -> DataFrame:
    """One row per transaction and rule of the weekend detector."""
    rule = F.explode(F.array(*[F.lit(r) for r in RULES])).alias("rule_name")
    hit = F.array_contains("metadata.violations", F.col("rule_name"))
    return weekend_result.select("transaction_id", "score", "metadata", rule).select(
        "transaction_id",
        F.lit(run_id).alias("run_id"),
        "rule_name",
        hit.alias("triggered"),
        F.when(hit, F.col("score")).alias("flag_value"),
        F.to_json("metadata").alias("metadata"),
    )


def write_rule_flags(weekend_result: DataFrame, path: str, run_id: str) -> None:
    _overwrite(rule_flags(weekend_result, run_id), path, "run_id")


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Scores or flags of one run, by partition."""
    return _stored(spark, path, "run_id").filter(F.col("run_id") == run_id)


def drop_partitions(spark: SparkSession, path: str, partition: str, values: DataFrame) -> int:
    """Delete the partitions named by the one column of ``values``; how many there were.

    The driver goes through names of partitions, as its listing of the table does.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    removed = 0
    for (value,) in values.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={escape(str(value))}")
        system = folder.getFileSystem(conf)
        if system.exists(folder):
            removed += bool(system.delete(folder, True))
    return removed
