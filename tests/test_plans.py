"""The physical plans hold what makes them scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oddledger.catalog.common import events_txn
from oddledger.operators.detectors import Transactions, get
from oddledger.operators.transform import add_time_features
from oddledger.plans import serve, strategy
from oddledger.session import scratch
from oddledger.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch(spark, "stored")
    df = events_txn(spark, FOLDER).withColumn("upload_id", F.date_format("timestamp", "yyyy-MM-dd"))
    tables.write_transactions(add_time_features(df), path)
    return path


def test_upload_is_a_pruned_partition(spark, stored):
    text = plan(tables.load_transactions(spark, stored, "2024-01-03"))
    assert re.search(r"PartitionFilters: \[.*upload_id", text)


def test_listing_filters_reach_the_scan(spark, stored):
    df = serve.list_transactions(
        tables.load_transactions(spark, stored), account_id="7", amount_min=5, date_from="2024-01-02"
    )
    pushed = re.search(r"PushedFilters: \[([^\n]*)", plan(df)).group(1)
    assert all(name in pushed for name in ("account_id", "amount", "timestamp"))


def test_summary_reads_only_its_columns(spark, stored):
    text = plan(serve.account_summaries(tables.load_transactions(spark, stored)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "raw_data" not in schema and "processed_data" not in schema


@pytest.mark.parametrize(
    "name, config",
    [
        ("zscore", None),
        ("correlation", None),
        ("correlation", {"correlation_type": "spearman"}),
        ("correlation", {"correlation_type": "kendall"}),
    ],
)
def test_one_exchange_per_account_detector(spark, name, config):
    text = plan(get("statistical", name).run(events_txn(spark, FOLDER), config))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"[+:]- \*?(?:\(\d+\) )?Sort ", text)) <= 1


def test_detectors_share_the_account_exchange(spark):
    names = [("statistical", "zscore"), ("rule_based", "weekend_threshold"), ("statistical", "correlation")]
    config = {"algorithms": [{"type": k, "name": n, "enabled": True} for k, n in names]}
    txns = Transactions(events_txn(spark, FOLDER))
    text = final_plan(strategy.run_strategy(txns, config))
    assert text.count("ReusedExchange") >= 2


def test_paging_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(serve.page(events_txn(spark, FOLDER), "amount"))


CHEAP = [n for n in entry.queries() if n[0] in "qpru" or n.startswith(("v0", "d1", "d3", "d4"))]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
