"""Analytic views over transactions and the fused result of a run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddledger.errors import ConfigError
from oddledger.functions.columns import pearson


def _with_flags(df: DataFrame, fused: DataFrame) -> DataFrame:
    """Only flagged rows of the result are joined."""
    hits = fused.filter("is_anomaly").select(
        F.col("transaction_id").alias("id"), "final_score", F.lit(1).alias("_hit")
    )
    return df.join(hits, "id", "left")


def daily_timeline(df: DataFrame, fused: DataFrame) -> DataFrame:
    """Flagged and all transactions per day."""
    return (
        _with_flags(df.select("id", "timestamp"), fused)
        .groupBy(F.to_date("timestamp").alias("day"))
        .agg(F.count("_hit").alias("anomalies"), F.count(F.lit(1)).alias("transactions"))
    )


def recent_flagged(df: DataFrame, fused: DataFrame, k: int = 5) -> DataFrame:
    """The latest flagged transactions."""
    hits = fused.filter("is_anomaly").select(
        F.col("transaction_id").alias("id"), "final_score", "final_confidence"
    )
    return df.join(hits, "id").orderBy(F.desc("timestamp"), "id").limit(k)


def weekly_kpis(df: DataFrame, fused: DataFrame, as_of: str) -> DataFrame:
    """The week before ``as_of`` and the change from the week before that."""
    end = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(end) - F.unix_micros("timestamp")) / (7 * 86_400_000_000.0)
    slim = df.select("id", "timestamp", "amount", age.alias("_age"))
    near = slim.filter(F.col("timestamp").between(end - F.expr("INTERVAL 14 DAYS"), end))
    near = _with_flags(near, fused)
    aggs = []
    for name, low, high in (("this", 0, 1), ("last", 1, 2)):
        week = (F.col("_age") >= low) & (F.col("_age") < high)
        hit = week & F.col("_hit").isNotNull()
        aggs += [
            F.count_if(week).alias(f"{name}_total"),
            F.count_if(hit).alias(f"{name}_flagged"),
            F.coalesce(F.sum(F.when(hit, F.abs("amount"))), F.lit(0.0)).alias(f"{name}_loss"),
            F.coalesce(10 * F.avg(F.when(hit, F.col("final_score"))), F.lit(0.0)).alias(
                f"{name}_risk"
            ),
        ]
    row = near.agg(*aggs)
    names = {
        "flagged": "flagged_transactions",
        "total": "total_transactions",
        "loss": "potential_loss",
        "risk": "risk_score",
    }
    out = []
    for short, long in names.items():
        now, before = F.col(f"this_{short}"), F.col(f"last_{short}")
        change = F.try_divide((now - before) * 100.0, before.cast("double"))
        out += [now.alias(long), change.alias(f"{long}_change")]
    return row.select(*out)


def account_statistics(df: DataFrame, fused: DataFrame) -> DataFrame:
    """U4: flagged and all transactions per account."""
    return (
        _with_flags(df.select("id", "account_id"), fused)
        .groupBy("account_id")
        .agg(
            F.count("_hit").alias("anomalies"),
            F.count(F.lit(1)).alias("transactions"),
            F.avg(F.col("_hit").isNotNull().cast("double")).alias("anomaly_rate"),
        )
    )


def busiest_accounts(df: DataFrame, k: int) -> list[str]:
    """The k accounts with most transactions; k rows reach the driver."""
    if k < 1:
        raise ConfigError("top_k must be positive")
    counts = df.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.orderBy(F.desc("n"), "account_id").limit(k).collect()
    return [r["account_id"] for r in rows]


def account_time_series(df: DataFrame, top_k: int = 5) -> DataFrame:
    """Transactions per day, one column per busy account."""
    accounts = busiest_accounts(df, top_k)
    return (
        df.filter(F.col("account_id").isin(accounts))
        .groupBy(F.to_date("timestamp").alias("day"))
        .pivot("account_id", accounts)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def account_correlation(
    df: DataFrame, as_of: str, days: int = 30, top_k: int = 10
) -> DataFrame:
    """Correlation of daily activity between the ``top_k`` busiest accounts.

    Daily counts, zeros included, are one row per account and day; accounts meet day by
    day, so the rows follow days * top_k ** 2, the size of the view itself.
    """
    if days < 1:
        raise ConfigError("days must be positive")
    end = dt.date.fromisoformat(as_of)
    start = end - dt.timedelta(days=days - 1)
    near = df.filter(
        (F.col("timestamp") >= F.lit(str(start)).cast("timestamp"))
        & (F.col("timestamp") < F.lit(str(end + dt.timedelta(days=1))).cast("timestamp"))
    )
    accounts = busiest_accounts(near, top_k)
    counted = (
        near.filter(F.col("account_id").isin(accounts))
        .groupBy(F.to_date("timestamp").alias("day"), "account_id")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    names = F.array(*[F.lit(a) for a in accounts]).cast("array<string>")
    calendar = df.sparkSession.range(days).select(
        F.date_add(F.lit(str(start)).cast("date"), F.col("id").cast("int")).alias("day"),
        F.explode(names).alias("account_id"),
    )
    dense = calendar.join(counted, ["day", "account_id"], "left").na.fill(0.0)
    left = dense.select("day", F.col("account_id").alias("account_a"), F.col("n").alias("_x"))
    right = dense.select("day", F.col("account_id").alias("account_b"), F.col("n").alias("_y"))
    return (
        left.join(right, "day")
        .groupBy("account_a", "account_b")
        .agg(pearson(F.col("_x"), F.col("_y")).alias("correlation"))
    )
