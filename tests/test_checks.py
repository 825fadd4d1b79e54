"""Validation, quality and profiles on literal rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddledger.operators import profile as p
from oddledger.operators import quality as q
from oddledger.operators import validate as v

NOW = "2024-01-01 00:00:00"


def test_typed_rows(spark):
    df = spark.createDataFrame(
        [("T1", 0.0, "ACC1"), ("T2", -5.0, "ab"), ("T3", 2e6, "test"), ("T4", 1.234, "ACC1")],
        "id string, amount double, account_id string",
    ).withColumn("timestamp", F.lit("2023-05-05").cast("timestamp"))
    found = {r["id"]: r for r in v.validate_rows(df, NOW).collect()}
    assert found["T1"]["warnings"] == ["amount.zero"]
    assert found["T2"]["warnings"] == ["amount.negative", "account.short"]
    assert "amount.large" in found["T3"]["warnings"]
    assert "account.test" in found["T3"]["warnings"]
    assert found["T4"]["warnings"] == ["amount.fraction"]
    assert all(not r["errors"] for r in found.values())


def test_missing_column_is_an_error_on_every_row(spark):
    df = spark.createDataFrame([("1", None)], "amount string, account_id string")
    row = v.validate_rows(df, NOW).first()
    assert row["errors"] == [
        "field.absent: timestamp", "field.null: account_id"
    ]


def test_batch(spark):
    rows = [("f", i, "1", f"2023-01-0{d} 00:00:00", "ACC1") for i, d in ((1, 1), (2, 3), (3, 2))]
    df = spark.createDataFrame(
        rows, "_source_file string, _row_number long, amount string, timestamp string, account_id string"
    ).withColumn("id", F.lit("same"))
    row = v.validate_batch(df, NOW).first()
    assert row["total_transactions"] == 3 and not row["valid"]
    assert row["batch_errors"] == ["batch.repeated_ids"]
    assert row["batch_warnings"] == ["batch.unordered"]
    assert row["span_days"] == 2


def test_order_between_files(spark):
    rows = [("a", 1, "2023-01-02"), ("a", 2, "2023-01-03"), ("b", 1, "2023-01-01")]
    df = spark.createDataFrame(rows, "_source_file string, _row_number long, timestamp string")
    assert v.out_of_order(df).first()[0]
    assert not v.out_of_order(df.filter("_source_file = 'a'")).first()[0]


def test_quality_of_empty_and_clean_data(spark):
    schema = "id string, amount double, timestamp timestamp, account_id string"
    row = q.quality_report(spark.createDataFrame([], schema), NOW).first()
    assert row["overall_quality"] == "poor" and row["issues"] == ["no_rows"]
    clean = spark.range(3).select(
        F.col("id").cast("string").alias("id"), F.lit(1.0).alias("amount"),
        F.lit("2023-01-01").cast("timestamp").alias("timestamp"), F.lit("A").alias("account_id"),
    )
    row = q.quality_report(clean, NOW).first()
    assert row["quality_score"] == 1.0 and row["overall_quality"] == "excellent"


@pytest.mark.parametrize(
    "values,outliers", [([100, 110, 105, 95, 98, 1000], 1), ([100] * 95 + [1000] * 5, 5)]
)
def test_outliers(spark, values, outliers):
    df = spark.createDataFrame([(float(x),) for x in values], "amount double")
    assert p.numeric_outliers(df, "amount").count() == outliers


def test_ranges(spark):
    df = spark.createDataFrame(
        [("1", 100.0, 0.5), ("2", -50.0, 1.2), ("3", 200.0, 0.8), ("4", -1000.0, -0.1)],
        "id string, amount double, score double",
    )
    found = p.range_violations(df, {"amount": (-500, 1000), "score": (0, 1)})
    counts = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
    assert counts == {"amount": 1, "score": 2}


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(100.0, "A"), (100.0, "A"), (None, "B")], "amount double, account_id string")
    found = {(r["column"], r["metric"]): r["value"] for r in p.missing_values(df).collect()}
    assert found[("amount", "missing_count")] == 1.0
    assert [r["column"] for r in p.columns_with_missing(df).collect()] == ["amount"]
    assert p.duplicate_summary(df).first()["duplicate_count"] == 1


def test_schema_changes():
    old = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    new = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("c", T.LongType())])
    found = {(c["column"], c["change"]): c["breaking"] for c in p.schema_changes(old, new, ["c"])}
    assert found == {("a", "type"): True, ("c", "added"): True, ("b", "removed"): False}


def test_suspicious_and_constant_columns(spark):
    df = spark.range(10).select(F.lit("A").alias("account_id"), F.lit(5.0).alias("amount"), "id")
    assert p.suspicious_accounts(df).first()["transaction_count"] == 10
    found = {(r["left"], r["right"]): r["correlation"] for r in p.correlation_matrix(df, ["amount", "id"]).collect()}
    assert found[("amount", "id")] is None and found[("id", "id")] == pytest.approx(1.0)
    assert p.histogram(df, "amount").filter("count > 0").first()["count"] == 10
