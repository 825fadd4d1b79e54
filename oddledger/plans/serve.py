"""Listing and reporting queries over stored transactions, scores, flags, runs, uploads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddledger.errors import ConfigError
from oddledger.operators.fusion import detector_log
from oddledger.operators.groups import POSITION, merge_rows, position_rows, table_stats
from oddledger.schema import (
    RUN_RETENTION_DAYS,
    RUN_STATUSES,
    UPLOAD_RETENTION_DAYS,
    UPLOAD_STATUSES,
)
from oddledger.sources.tables import drop_partitions

DEFAULT_MIN_SCORE = 0.7


def _day(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def list_transactions(
    df: DataFrame,
    upload_id: str | None = None,
    account_id: str | None = None,
    amount_min: float | None = None,
    amount_max: float | None = None,
    date_from: str | dt.date | None = None,
    date_to: str | dt.date | None = None,
    search: str | None = None,
    category: str | None = None,
    is_weekend: bool | None = None,
    day_of_week: int | None = None,
    has_anomalies: bool | None = None,
    flagged: DataFrame | None = None,
) -> DataFrame:
    """R1, R2, R4.  Plain comparisons reach the Parquet scan; the end day counts.

    ``flagged`` holds the ``transaction_id`` of flagged rows and is needed for
    ``has_anomalies`` only.
    """
    if upload_id is not None:
        df = df.filter(F.col("upload_id") == upload_id)
    if account_id is not None:
        df = df.filter(F.col("account_id") == account_id)
    if amount_min is not None:
        df = df.filter(F.col("amount") >= amount_min)
    if amount_max is not None:
        df = df.filter(F.col("amount") <= amount_max)
    if date_from is not None:
        df = df.filter(F.col("timestamp") >= F.lit(str(_day(date_from))).cast("timestamp"))
    if date_to is not None:
        after = _day(date_to) + dt.timedelta(days=1)
        df = df.filter(F.col("timestamp") < F.lit(str(after)).cast("timestamp"))
    if category is not None:
        df = df.filter(F.col("category") == category)
    if is_weekend is not None:
        weekend = F.weekday("timestamp") >= 5
        df = df.filter(weekend if is_weekend else ~weekend)
    if day_of_week is not None:
        df = df.filter(F.weekday("timestamp") == day_of_week)
    if search:
        df = df.filter(text_match(df, search))
    if has_anomalies is not None:
        if flagged is None:
            raise ConfigError("has_anomalies needs the flagged transactions")
        ids = flagged.select(F.col("transaction_id").alias("id"))
        df = df.join(ids, "id", "left_semi" if has_anomalies else "left_anti")
    return df


def text_match(df: DataFrame, text: str) -> Column:
    """Case-insensitive substring in the external id or the raw record."""
    literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for name in ("external_transaction_id", "raw_data"):
        if name in df.columns:
            found = found | F.coalesce(F.col(name).ilike(f"%{literal}%"), F.lit(False))
    return found


def page(
    df: DataFrame,
    sort_by: str = "timestamp",
    sort_order: str = "desc",
    page: int = 1,
    per_page: int = 20,
    tie: str = "id",
) -> DataFrame:
    """One page in a total order (top-k, no full sort); ``far_page`` for those far behind."""
    key = _sort_key(df, sort_by, sort_order)
    ordered = df.orderBy(key, tie) if tie in df.columns and tie != sort_by else df.orderBy(key)
    return ordered.offset((page - 1) * per_page).limit(per_page)


def _sort_key(df: DataFrame, sort_by: str, sort_order: str) -> Column:
    if sort_order not in ("asc", "desc"):
        raise ConfigError('sort_order must be "asc" or "desc"')
    if sort_by not in df.columns:
        raise ConfigError(f"cannot sort by {sort_by}")
    return F.col(sort_by).desc_nulls_last() if sort_order == "desc" else F.col(sort_by).asc_nulls_last()


def page_after(
    df: DataFrame,
    after: tuple | None = None,
    sort_by: str = "timestamp",
    sort_order: str = "desc",
    per_page: int = 20,
    tie: str = "id",
) -> DataFrame:
    """The page behind the row with the sort value and tie value ``after``.

    Rows before it are filtered out where they lie, so every page costs what the first costs.
    """
    key = _sort_key(df, sort_by, sort_order)
    if after is not None:
        value, last = after
        column = F.col(sort_by)
        if value is None:
            df = df.filter(column.isNull() & (F.col(tie) > last))
        else:
            beyond = column < F.lit(value) if sort_order == "desc" else column > F.lit(value)
            same = (column == F.lit(value)) & (F.col(tie) > last)
            df = df.filter(beyond | same | column.isNull())
    return df.orderBy(key, tie).limit(per_page)


def far_page(
    df: DataFrame,
    sort_by: str = "timestamp",
    sort_order: str = "desc",
    page: int = 1,
    per_page: int = 20,
    tie: str = "id",
) -> DataFrame:
    """A page by its number, however far.

    Keys alone are sorted over all tasks and numbered from the counts of the ranges; the rows
    of one page are then looked up, so no task gathers the pages before it.
    """
    order = [_sort_key(df, sort_by, sort_order), F.col(tie).asc()]
    keys = df.select(tie, sort_by).withColumn("_one", F.lit(1))
    placed = position_rows(keys, ["_one"], order, POSITION)
    first = (page - 1) * per_page
    wanted = placed.filter(F.col(POSITION).between(first + 1, first + per_page)).select(tie).distinct()
    rows = df.join(F.broadcast(wanted), tie, "left_semi").select(df.columns)
    return rows.orderBy(*order)


def page_info(df: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """Total and neighbours of the page."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        (F.col("total") > page * per_page).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def transaction_details(df: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Transactions with all their scores and flags.

    Filter ``df`` to the wanted ids first; a transaction has as many scores as
    detectors ran on it, so the lists stay short.
    """
    found = scores.groupBy("transaction_id").agg(
        F.max("score").alias("max_anomaly_score"),
        F.array_sort(
            F.collect_list(F.struct("algorithm_type", "algorithm_name", "score", "confidence"))
        ).alias("anomaly_scores"),
        F.array_sort(
            F.collect_set(
                F.when(
                    F.col("score") >= DEFAULT_MIN_SCORE,
                    F.concat_ws(".", "algorithm_type", "algorithm_name"),
                )
            )
        ).alias("anomaly_algorithms_triggered"),
    )
    rules = flags.groupBy("transaction_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("triggered"), F.col("rule_name")))).alias(
            "rule_flags_triggered"
        )
    )
    empty = F.array().cast("array<string>")
    return (
        df.join(found.withColumnRenamed("transaction_id", "id"), "id", "left")
        .join(rules.withColumnRenamed("transaction_id", "id"), "id", "left")
        .withColumns(
            {
                "anomaly_algorithms_triggered": F.coalesce("anomaly_algorithms_triggered", empty),
                "rule_flags_triggered": F.coalesce("rule_flags_triggered", empty),
            }
        )
    )


def flagged_transactions(
    df: DataFrame,
    scores: DataFrame,
    min_score: float = DEFAULT_MIN_SCORE,
    run_id: str | None = None,
    algorithm_type: str | None = None,
) -> DataFrame:
    """Transactions with their highest score; page it by score."""
    if run_id is not None:
        scores = scores.filter(F.col("run_id") == run_id)
    if algorithm_type is not None:
        scores = scores.filter(F.col("algorithm_type") == algorithm_type)
    best = (
        scores.filter(F.col("score") >= min_score)
        .groupBy(F.col("transaction_id").alias("id"))
        .agg(F.max("score").alias("anomaly_score"))
    )
    return df.join(best, "id")


def transaction_stats(df: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Totals of a filtered transaction set, with flagged count when given."""
    stats = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.avg("amount"), F.lit(0.0)).alias("average_amount"),
        F.coalesce(F.min("amount"), F.lit(0.0)).alias("min_amount"),
        F.coalesce(F.max("amount"), F.lit(0.0)).alias("max_amount"),
        F.countDistinct("account_id").alias("unique_accounts"),
        F.min("timestamp").alias("date_range_start"),
        F.max("timestamp").alias("date_range_end"),
    )
    if flagged is None:
        return stats
    ids = flagged.select(F.col("transaction_id").alias("id"))
    hits = df.join(ids, "id", "left_semi").agg(F.count(F.lit(1)).alias("anomaly_count"))
    share = F.try_divide(F.col("anomaly_count").cast("double"), F.col("total_transactions"))
    return merge_rows(stats, hits).withColumn("anomaly_rate", F.coalesce(share, F.lit(0.0)))


def transactions_by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("transactions")
    )


def transactions_by_category(df: DataFrame, column: str = "category") -> DataFrame:
    name = F.coalesce(F.col(column), F.lit("uncategorized"))
    return df.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("transactions"))


def account_summaries(
    df: DataFrame, min_transactions: int = 1, flagged: DataFrame | None = None
) -> DataFrame:
    """One row per account, busiest first."""
    if flagged is not None:
        ids = flagged.select(F.col("transaction_id").alias("id"), F.lit(1).alias("_hit")).distinct()
        df = df.join(ids, "id", "left")
    hits = F.count("_hit") if flagged is not None else F.lit(0).cast("long")
    return (
        df.groupBy("account_id")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum("amount").alias("total_amount"),
            F.avg("amount").alias("average_amount"),
            F.min("amount").alias("min_amount"),
            F.max("amount").alias("max_amount"),
            F.min("timestamp").alias("first_transaction"),
            F.max("timestamp").alias("last_transaction"),
            hits.alias("anomalies_detected"),
        )
        .filter(F.col("transaction_count") >= min_transactions)
        .orderBy(F.desc("transaction_count"), "account_id")
    )


def run_results(
    scores: DataFrame, run_id: str, min_score: float = DEFAULT_MIN_SCORE
) -> DataFrame:
    """The scores of a run above the threshold (one partition of the table)."""
    return scores.filter((F.col("run_id") == run_id) & (F.col("score") >= min_score))


def run_flags(flags: DataFrame, run_id: str) -> DataFrame:
    """The triggered rules of a run."""
    return flags.filter((F.col("run_id") == run_id) & F.col("triggered"))


def best_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("transaction_id").agg(F.max("score").alias("score"))


def results_totals(scores: DataFrame, min_score: float = DEFAULT_MIN_SCORE) -> DataFrame:
    """Transactions, flagged ones, percentage."""
    return best_scores(scores).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("score") >= min_score).alias("anomalous_transactions"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("score") >= min_score) * 100.0, F.count(F.lit(1))),
            F.lit(0.0),
        ).alias("anomaly_percentage"),
    )


def results_by_rule(flags: DataFrame) -> DataFrame:
    """Per rule how often it was checked and triggered."""
    return flags.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("triggered").alias("triggered")
    )


def top_anomalies(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k transactions with the highest score."""
    return best_scores(scores).orderBy(F.desc("score"), "transaction_id").limit(k)


def score_distribution(scores: DataFrame, rows: int | None = None) -> DataFrame:
    """Quantiles, mean and spread of the score per transaction."""
    best = best_scores(scores)
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    stats = {
        "mean_score": F.avg("score"),
        "std_score": F.stddev_samp("score"),
        "min_score": F.min("score"),
        "max_score": F.max("score"),
    }
    return table_stats(best, stats, {n: ("score", p) for n, p in probs.items()}, rows)


def results_summary(scores: DataFrame, flags: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """All parts of the summary of a run."""
    return {
        "totals": results_totals(scores),
        "algorithm_results": detector_log(scores),
        "rule_results": results_by_rule(flags),
        "top_anomalies": top_anomalies(scores, k),
        "distribution_stats": score_distribution(scores),
    }


def _known(status: str | None, statuses: list[str]) -> None:
    if status is not None and status not in statuses:
        raise ConfigError(f"status must be one of {statuses}")


def list_runs(
    runs: DataFrame,
    upload_id: str | None = None,
    strategy_id: str | None = None,
    status: str | None = None,
    page_number: int = 1,
    per_page: int = 20,
) -> DataFrame:
    """Newest runs first."""
    _known(status, RUN_STATUSES)
    for name, value in (("upload_id", upload_id), ("strategy_id", strategy_id), ("status", status)):
        if value is not None:
            runs = runs.filter(F.col(name) == value)
    return page(runs, "started_at", "desc", page_number, per_page)


def list_uploads(
    uploads: DataFrame, status: str | None = None, page_number: int = 1, per_page: int = 20
) -> DataFrame:
    """Newest uploads first."""
    _known(status, UPLOAD_STATUSES)
    if status is not None:
        uploads = uploads.filter(F.col("status") == status)
    return page(uploads, "upload_timestamp", "desc", page_number, per_page)


def upload_stats(uploads: DataFrame) -> DataFrame:
    """Uploads by outcome and their bytes."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    return uploads.agg(
        F.count(F.lit(1)).alias("total_uploads"),
        is_("processed").alias("successful_uploads"),
        is_("failed").alias("failed_uploads"),
        is_("uploaded", "processing").alias("processing_uploads"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size_bytes"),
    )


def _seconds(end: str, start: str) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000.0


def processing_stats(uploads: DataFrame, txns: DataFrame) -> DataFrame:
    """Uploads, bytes, stored transactions, mean processing seconds."""
    took = _seconds("processed_at", "upload_timestamp")
    return merge_rows(
        uploads.agg(
            F.count(F.lit(1)).alias("total_uploads"),
            F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_file_size_bytes"),
            F.coalesce(F.avg(took), F.lit(0.0)).alias("average_processing_time_seconds"),
        ),
        txns.agg(F.count(F.lit(1)).alias("total_transactions_processed")),
    )


def status_counts(table: DataFrame) -> DataFrame:
    """Rows per status."""
    return table.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Runs, mean duration, mean rate of flagged transactions."""
    took = _seconds("completed_at", "started_at")
    return runs.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.coalesce(F.avg(took), F.lit(0.0)).alias("average_execution_time_seconds"),
        F.coalesce(F.avg("anomaly_rate"), F.lit(0.0)).alias("average_anomaly_rate"),
    )


def _older(time: str, days: int, now: str) -> Column:
    return F.col(time) < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))


def expired_uploads(uploads: DataFrame, now: str, days: int = UPLOAD_RETENTION_DAYS) -> DataFrame:
    return uploads.filter(_older("upload_timestamp", days, now))


def retention(
    uploads: DataFrame, txns: DataFrame, now: str, days: int = UPLOAD_RETENTION_DAYS
) -> DataFrame:
    """Transactions whose upload is not expired."""
    expired = expired_uploads(uploads, now, days).select(F.col("id").alias("upload_id"))
    return txns.join(expired, "upload_id", "left_anti")


def run_retention(runs: DataFrame, now: str, days: int = RUN_RETENTION_DAYS) -> DataFrame:
    """Runs that are kept; runs that never ended are kept too."""
    return runs.filter(~F.coalesce(_older("completed_at", days, now), F.lit(False)))


def remove_expired(
    spark: SparkSession, uploads: DataFrame, path: str, now: str, days: int = UPLOAD_RETENTION_DAYS
) -> int:
    """Delete the stored transactions of expired uploads; the number of uploads removed.

    Only the partitions of expired uploads are touched.  A run that broke off may be repeated:
    what is gone already is passed over.
    """
    ids = expired_uploads(uploads, now, days).select("id").distinct()
    return drop_partitions(spark, path, "upload_id", ids)


def remove_expired_runs(
    spark: SparkSession, runs: DataFrame, path: str, now: str, days: int = RUN_RETENTION_DAYS
) -> int:
    """The same for the scores or flags of runs that ended long ago."""
    ids = runs.filter(F.coalesce(_older("completed_at", days, now), F.lit(False))).select("id").distinct()
    return drop_partitions(spark, path, "run_id", ids)
