"""Audit of a landing folder: one row per file, contents read only to parse them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddledger.functions.columns import messages
from oddledger.schema import (
    ALLOWED_FILE_TYPES,
    DANGEROUS_NAME_PARTS,
    FILE_TYPE_BY_EXTENSION,
    LARGE_FILE_BYTES,
    MAX_FILE_BYTES,
)
from oddledger.sources.readers import plain_path, read_json_parts

MAX_NAME = 255


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes; the ``content`` column is pruned, so nothing is read.

    A scan leaves empty files out; they are in the listing Spark has made.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = scan.select(
        F.regexp_replace("path", r"^([A-Za-z0-9]+):/+", "$1:/").alias("path"),
        F.col("length").alias("size"),
    )
    listed = spark.createDataFrame([(f,) for f in scan.inputFiles()], "path string")
    return (
        listed.select(plain_path(F.col("path")).alias("path"))
        .join(sizes, "path", "left")
        .select("path", F.coalesce("size", F.lit(0)).alias("size"))
    )


def corrupt_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, broken)``: records that do not parse, of the files that have any."""
    # the readers want a data column beside the corrupt record
    data = T.StructType([T.StructField("id", T.StringType())])
    scan = {"recursiveFileLookup": True}
    _, json = read_json_parts(spark, path, data, pathGlobFilter="*.json", **scan)
    xml = (
        spark.read.format("xml")
        .schema(T.StructType([*data.fields, T.StructField("_corrupt_record", T.StringType())]))
        .options(rowTag="transaction", columnNameOfCorruptRecord="_corrupt_record", pathGlobFilter="*.xml", **scan)
        .load(path)
        .select(
            F.when(F.col("_corrupt_record").isNotNull(), F.coalesce("id", F.lit(""))).alias("bad"),
            F.col("_metadata.file_path").alias("_source_path"),
        )
    )
    both = json.select(F.lit("").alias("bad"), "_source_path").unionByName(xml)
    return both.groupBy(plain_path(F.col("_source_path")).alias("path")).agg(F.count("bad").alias("broken"))


def audit_landing(
    spark: SparkSession,
    path: str,
    max_bytes: int = MAX_FILE_BYTES,
    allowed: list[str] | None = None,
) -> DataFrame:
    """``(path, file, type, size, rejected, errors, warnings, valid)`` per file.

    ``rejected`` counts the records of JSON and XML files that do not parse.
    """
    allowed = allowed or ALLOWED_FILE_TYPES
    files = list_files(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    ending = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in FILE_TYPE_BY_EXTENSION.items() for x in pair])
    files = files.withColumn("type", F.element_at(types, ending))
    files = files.join(corrupt_files(spark, path), "path", "left")
    mb = lambda c: F.format_string("%.2f", c / (1024 * 1024))
    bad_part = F.coalesce(
        *[F.when(F.contains("file", F.lit(p)), F.lit(p)) for p in DANGEROUS_NAME_PARTS]
    )
    size = F.col("size")
    errors = messages(
        (size == 0, "file.empty"),
        (
            size > max_bytes,
            F.concat(
                F.lit("file.size: "), mb(size), F.lit(" MB, at most "), mb(F.lit(max_bytes)),
                F.lit(" MB"),
            ),
        ),
        (
            F.col("type").isNull() | ~F.col("type").isin(allowed),
            F.concat(F.lit("file.type: "), F.coalesce("type", ending)),
        ),
        (bad_part.isNotNull(), F.concat(F.lit("name.part: "), bad_part)),
        (F.length("file") > MAX_NAME, f"name.long: at most {MAX_NAME}"),
        (
            (size > 0) & (F.col("broken") > 0),
            F.concat(F.lit("content.broken: "), "type"),
        ),
    )
    warnings = messages(
        (size > LARGE_FILE_BYTES, "file.large"),
        (~F.contains("file", F.lit(".")), "name.no_ending"),
    )
    return files.select(
        "path",
        "file",
        "type",
        "size",
        F.coalesce("broken", F.lit(0)).cast("long").alias("rejected"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        (F.size(errors) == 0).alias("valid"),
    )
