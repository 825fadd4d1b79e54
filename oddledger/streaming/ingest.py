"""Incremental ingest: every file that lands becomes a stored upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from oddledger.operators.transform import (
    add_account_order,
    add_amount_category,
    add_amount_features,
    add_time_features,
    dedupe_ids,
    ensure_ids,
    parse_rows,
    require_fields,
)
from oddledger.session import staged, temporary
from oddledger.sources.readers import csv_rows, stored_lines
from oddledger.sources.tables import write_transactions

KEY = "_account_key"


def landed_files(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Stream of text lines with the file and block they come from; a batch has whole files."""
    reader = spark.readStream
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.text(folder).select("value", "_metadata")


def store_batch(batch: DataFrame, out_dir: str, schema: T.StructType | None = None) -> None:
    """Ids and account order per upload, then the upload's partition is replaced.

    The lines are stored before anything reads them twice, and the copy is removed when the
    uploads are written.  Columns go by the header of their file.  Ids follow from the file
    and the row alone, so they do not depend on which files share a batch.
    """
    with temporary(batch.sparkSession):
        rows = staged(parse_rows(csv_rows(stored_lines(batch), schema=schema)), "parsed")
        rows = rows.withColumn("upload_id", F.sha2("_source_path", 256))
        df = dedupe_ids(ensure_ids(rows), within=("upload_id",))
        df = require_fields(df, check_empty=False).drop("_source_path", "_row_number")
        df = add_amount_category(add_amount_features(add_time_features(df)))
        df = df.withColumn(KEY, F.concat_ws("|", "upload_id", "account_id"))
        df = add_account_order(df, key=KEY).drop(KEY)
        write_transactions(df, out_dir)


def start_ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    files_per_batch: int | None = None,
    continuous: str | None = None,
) -> StreamingQuery:
    """ST1: process what has landed and stop, or keep going every ``continuous``.

    ``schema`` names the columns to take; without it all columns of the headers are taken.
    """
    stream = landed_files(spark, in_dir, files_per_batch)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: store_batch(batch, out_dir, schema)
    )
    writer = (
        writer.trigger(processingTime=continuous)
        if continuous
        else writer.trigger(availableNow=True)
    )
    return writer.start()
