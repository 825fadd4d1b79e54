"""Queries for strategies, fusion, listings, reports, views and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddledger.catalog.common import FEATS, TXN, events_txn, joined, micros, r6
from oddledger.catalog.detect import TIMESERIES_SQL, WEEKEND_SQL, weekend_sql, zscore_sql
from oddledger.operators import detectors as det
from oddledger.operators.groups import merge_rows
from oddledger.operators.fusion import detector_log, run_summary
from oddledger.operators.transform import add_time_features
from oddledger.plans import serve, strategy, views
from oddledger.schema import UPLOAD_STATUSES
from oddledger.session import scratch
from oddledger.sources import tables
from oddledger.streaming.ingest import start_ingest
from oddledger.streaming.score import score_stream, start_scoring

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _spec(kind: str, name: str, **config) -> dict:
    return {"type": kind, "name": name, "enabled": True, "config": config}


def _strategy(method: str = "max", threshold: float = 0.7, weights: dict | None = None) -> dict:
    settings = {"aggregation_method": method, "confidence_threshold": threshold}
    if weights:
        settings["weights"] = weights
    return {
        "algorithms": [
            _spec("statistical", "zscore"),
            _spec("statistical", "timeseries"),
            _spec("rule_based", "weekend_threshold"),
        ],
        "global_settings": settings,
    }


TWO = {
    "algorithms": [_spec("statistical", "zscore"), _spec("rule_based", "weekend_threshold")],
    "global_settings": {"aggregation_method": "max", "confidence_threshold": 0.7},
}

_BASE = f"{zscore_sql()}, {TIMESERIES_SQL}, {WEEKEND_SQL}"
_WIDE = f"""{_BASE}, wi AS (SELECT txn.id, zs.score AS s0, zs.confidence AS c0, co.score AS s1, co.confidence AS c1, wk.score AS s2,
   wk.confidence AS c2 FROM txn LEFT JOIN zs USING (id) LEFT JOIN co USING (id) LEFT JOIN wk USING (id))"""
_TWO_SCORES = f"""{zscore_sql()}, {WEEKEND_SQL}, sc AS (
   SELECT id AS transaction_id, 'statistical' AS algorithm_type, 'zscore' AS algorithm_name, 0 AS ordinal, score, confidence FROM zs
   UNION ALL SELECT id, 'rule_based', 'weekend_threshold', 1, score, confidence FROM wk)"""


@query(
    "f01_run_strategy",
    f"""WITH {_TWO_SCORES} SELECT transaction_id, algorithm_type, algorithm_name, CAST(ordinal AS INTEGER) AS ordinal,
    round(score, 6) AS score, round(confidence, 6) AS confidence FROM sc""",
)
def f01(spark, d):
    return strategy.run_strategy(events_txn(spark, d), TWO).select(
        "transaction_id", "algorithm_type", "algorithm_name", "ordinal",
        r6("score").alias("score"), r6("confidence").alias("confidence"),
    )


def _fused(method: str, weights: dict | None = None):
    def run(spark, d):
        found = strategy.analyse(events_txn(spark, d), _strategy(method, weights=weights))
        return found.select(
            "transaction_id",
            r6("final_score").alias("final_score"),
            r6("final_confidence").alias("final_confidence"),
        )

    return run


def _fused_sql(score: str, confidence: str) -> str:
    return f"""WITH {_WIDE} SELECT id AS transaction_id, round({score}, 6) AS final_score, round({confidence}, 6) AS final_confidence FROM wi"""


_MAX, _MIN = "greatest(s0, s1, s2)", "least(s0, s1, s2)"
_first = "CASE WHEN s0 = {0} THEN c0 WHEN s1 = {0} THEN c1 ELSE c2 END".format
_mean = "(coalesce({0}0, 0) + {0}1 + {0}2) / (CASE WHEN s0 IS NULL THEN 2 ELSE 3 END)".format
_weighted = (
    "(coalesce({0}0, 0) * 0.4 + {0}1 * 0.4 + {0}2 * 0.3) / (CASE WHEN s0 IS NULL THEN 0.7 ELSE 1.1 END)".format
)
for _name, _method, _weights, _s, _c in [
    ("f02_fuse_max", "max", None, _MAX, _first(_MAX)),
    ("f03_fuse_min", "min", None, _MIN, _first(_MIN)),
    ("f04_fuse_mean", "mean", None, _mean("s"), _mean("c")),
    (
        "f05_fuse_weighted", "weighted_average", {"statistical": 0.4, "rule_based": 0.3},
        _weighted("s"), _weighted("c"),
    ),
]:
    QUERIES[_name] = _fused(_method, _weights)
    SQL[_name] = _fused_sql(_s, _c)


@query(
    "f06_fused_details",
    f"""WITH {_WIDE} SELECT id AS transaction_id, {_MAX} >= 0.7 AS is_anomaly,
    concat_ws('; ', CASE WHEN s0 IS NOT NULL THEN 'statistical.zscore' END, 'statistical.timeseries', 'rule_based.weekend_threshold') AS algorithms_used,
    concat_ws('; ', CAST(CAST(round(s0 * 1000) AS BIGINT) AS VARCHAR), CAST(CAST(round(s1 * 1000) AS BIGINT) AS VARCHAR),
      CAST(CAST(round(s2 * 1000) AS BIGINT) AS VARCHAR)) AS individual_scores FROM wi""",
)
def f06(spark, d):
    found = strategy.analyse(events_txn(spark, d), _strategy())
    values = F.transform(
        F.map_values("individual_scores"), lambda v: F.round(v * 1000).cast("long").cast("string")
    )
    return found.select(
        "transaction_id",
        "is_anomaly",
        joined("algorithms_used").alias("algorithms_used"),
        joined(values).alias("individual_scores"),
    )


@query(
    "f07_run_summary",
    f"""WITH {_WIDE} SELECT count(*) FILTER ({_MAX} >= 0.7) AS anomaly_count, count(*) AS total_transactions,
    round(count(*) FILTER ({_MAX} >= 0.7) / count(*), 6) AS anomaly_rate,
    'rule_based.weekend_threshold; statistical.timeseries; statistical.zscore' AS algorithms_executed FROM wi""",
)
def f07(spark, d):
    found = run_summary(strategy.analyse(events_txn(spark, d), _strategy()))
    return found.withColumns(
        {
            "anomaly_rate": r6("anomaly_rate"),
            "algorithms_executed": joined("algorithms_executed"),
        }
    )


_LOG = """SELECT algorithm_type, algorithm_name, count(*) AS transactions_analyzed, count(*) FILTER (score > 0.5) AS anomalies_found,
    round(avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate, round(avg(score), 6) AS average_score,
    round(max(score), 6) AS max_score FROM sc GROUP BY ALL"""


@query("f08_detector_log", f"WITH {_TWO_SCORES} {_LOG}")
def f08(spark, d):
    found = detector_log(strategy.run_strategy(events_txn(spark, d), TWO))
    return found.withColumns({c: r6(c) for c in ("anomaly_rate", "average_score", "max_score")})


@query(
    "f09_preset_basic",
    f"""WITH {zscore_sql()} SELECT id AS transaction_id, round(score, 6) AS final_score, score >= 0.7 AS is_anomaly FROM zs""",
)
def f09(spark, d):
    found = strategy.analyse(
        events_txn(spark, d), strategy.PRESETS["Basic Statistical Detection"]
    )
    return found.select("transaction_id", r6("final_score").alias("final_score"), "is_anomaly")


@query(
    "f09_preset_rules",
    f"""WITH {TXN}, {weekend_sql(0.2)} SELECT id AS transaction_id, round(score, 6) AS final_score, score >= 0.8 AS is_anomaly FROM wk""",
)
def f09_rules(spark, d):
    """One of its two rules exists nowhere and is skipped."""
    found = strategy.analyse(events_txn(spark, d), strategy.PRESETS["Rule-Based Only"])
    return found.select("transaction_id", r6("final_score").alias("final_score"), "is_anomaly")


@query("f09_preset_comprehensive")
def f09b(spark, d):
    found = strategy.analyse(
        events_txn(spark, d), strategy.PRESETS["Comprehensive Multi-Algorithm"]
    )
    return found.select("transaction_id", r6("final_score").alias("final_score"), "is_anomaly")


@query(
    "f09_preset_comprehensive_facts",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS unlike, 3 AS detectors, 0 AS skipped FROM events",
)
def f09b_facts(spark, d):
    """Every transaction has a result of all three detectors, flagged by the preset's limit."""
    preset = strategy.PRESETS["Comprehensive Multi-Algorithm"]
    found = strategy.analyse(events_txn(spark, d), preset)
    limit = preset["global_settings"]["confidence_threshold"]
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_anomaly") != (F.col("final_score") >= limit)).alias("unlike"),
        F.max(F.size("algorithms_used")).alias("detectors"),
        F.max(F.size("algorithms_skipped")).alias("skipped"),
    )


@query(
    "f01_run_report",
    f"""WITH {TXN} SELECT 'statistical.zscore' AS detector, count(*) >= 2 AS ran FROM txn
      UNION ALL SELECT 'rule_based.periodization', false""",
)
def f01_report(spark, d):
    """A detector that exists nowhere is named in the report."""
    plan = {"algorithms": [_spec("statistical", "zscore"), _spec("rule_based", "periodization")]}
    run = strategy.plan_strategy(events_txn(spark, d), plan)
    return strategy.run_report(run, spark).select("detector", "ran")


_CHARACTER = """SELECT count(*) AS transaction_count, count(DISTINCT account_id) AS unique_accounts,
    CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000) AS BIGINT) AS date_range_days,
    round(avg(amount), 6) AS amount_mean, round(stddev_samp(amount), 6) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max,
    round(skewness(amount), 6) AS amount_skewness, round(median(amount), 6) AS amount_median,
    round(avg(CASE WHEN is_weekend THEN 1.0 ELSE 0.0 END), 6) AS weekend_ratio,
    round(avg(CASE WHEN is_business_hours THEN 1.0 ELSE 0.0 END), 6) AS business_hours_ratio, 1.0 AS completeness,
    0.0 AS duplicate_rate, round(stddev_samp(amount) / avg(amount), 6) AS outlier_potential, '' AS missing_critical_fields FROM ft"""


@query("f10_data_characteristics", f"WITH {TXN}, {FEATS} {_CHARACTER}")
def f10(spark, d):
    row = strategy.data_characteristics(add_time_features(events_txn(spark, d)))
    numbers = [
        "amount_mean", "amount_std", "amount_skewness", "amount_median", "weekend_ratio",
        "business_hours_ratio", "completeness", "duplicate_rate", "outlier_potential",
    ]
    return row.withColumns({c: r6(c) for c in numbers}).withColumn(
        "missing_critical_fields", joined("missing_critical_fields")
    )


@query(
    "f11_tune",
    f"""WITH {TXN}, {FEATS}, st AS (SELECT count(*) AS n, stddev_samp(amount) / avg(amount) AS op,
      avg(CASE WHEN is_weekend THEN 1.0 ELSE 0.0 END) AS wr FROM ft)
    SELECT n AS transaction_count, round(CASE WHEN op < 0.5 THEN 2.4 WHEN op > 2 THEN 3.6 ELSE 3.0 END, 6) AS threshold,
      CAST(CASE WHEN n < 100 THEN 10 WHEN n > 10000 THEN 100 ELSE 30 END AS INTEGER) AS window_size,
      round(CASE WHEN wr < 0.1 THEN 0.15 WHEN wr > 0.3 THEN 0.45 ELSE 0.3 END, 6) AS weekend_multiplier FROM st""",
)
def f11(spark, d):
    stats = strategy.data_characteristics(add_time_features(events_txn(spark, d)))
    changes = strategy.tuning(TWO, stats)

    def tuned(setting, default):
        new = F.max(F.when(F.col("parameter") == setting, F.col("new")))
        return F.coalesce(new, F.lit(float(default))).alias(setting)

    settings = changes.agg(
        tuned("threshold", 3.0), tuned("window_size", 30), tuned("weekend_multiplier", 0.3)
    )
    return merge_rows(stats.select("transaction_count"), settings).select(
        "transaction_count",
        r6("threshold").alias("threshold"),
        F.col("window_size").cast("int").alias("window_size"),
        r6("weekend_multiplier").alias("weekend_multiplier"),
    )


@query(
    "f12_compatibility",
    """SELECT 'statistical' AS algorithm_type, 'zscore' AS algorithm_name, 2 AS min_rows, true AS valid,
      (SELECT count(*) FROM events) AS available_rows, (SELECT count(*) FROM events) >= 2 AS min_rows_met
    UNION ALL SELECT 'rule_based', 'weekend_threshold', 10, true, (SELECT count(*) FROM events), (SELECT count(*) FROM events) >= 10
    UNION ALL SELECT 'rule_based', 'periodization', NULL, false, (SELECT count(*) FROM events), NULL""",
)
def f12(spark, d):
    mixed = {"algorithms": [*TWO["algorithms"], _spec("rule_based", "periodization")]}
    return strategy.compatibility(mixed, events_txn(spark, d)).drop("error")


_SAMPLED = TXN.replace("txn AS", "every AS") + """, txn AS (
  SELECT * FROM every ORDER BY sha256(id), id LIMIT 500)"""


@query(
    "f13_preview",
    f"""WITH {_TWO_SCORES.replace(TXN, _SAMPLED)} SELECT transaction_id, round(max(score), 6) AS final_score,
      max(score) >= 0.7 AS is_anomaly FROM sc GROUP BY 1""",
)
def f13(spark, d):
    found = strategy.preview(TWO, events_txn(spark, d), 500)
    return found.select("transaction_id", r6("final_score").alias("final_score"), "is_anomaly")


@query(
    "f13_compare_strategies",
    f"""WITH {zscore_sql()}, {zscore_sql('zsx AS (SELECT 1)', 3.0, 50, 'zt')}, {WEEKEND_SQL}
    SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) FILTER (zs.score >= 0.7) AS current,
      count(*) FILTER (wk.score >= 0.7 OR zt.score >= 0.7) AS proposed
    FROM txn LEFT JOIN zs USING (id) LEFT JOIN zt USING (id) LEFT JOIN wk USING (id)
    WHERE zs.score >= 0.7 OR wk.score >= 0.7 OR zt.score >= 0.7 GROUP BY 1""",
)
def f13b(spark, d):
    proposed = {
        "algorithms": [
            _spec("statistical", "zscore", window_size=50), _spec("rule_based", "weekend_threshold")
        ]
    }
    found = strategy.compare_strategies(strategy.DEFAULT_STRATEGY, proposed, events_txn(spark, d))
    return found.withColumn("day", F.col("day").cast("string"))


@query(
    "f14_checked_presets",
    f"""WITH {zscore_sql()} SELECT 'Basic Statistical Detection' AS preset, true AS valid, count(*) FILTER (score >= 0.7) AS flagged FROM zs
    UNION ALL SELECT 'Rule-Based Only', false, NULL""",
)
def f14(spark, d):
    """Only strategies that pass the check are run."""
    out = None
    for name in ("Basic Statistical Detection", "Rule-Based Only"):
        preset = strategy.PRESETS[name]
        ok = strategy.check_strategy(preset)["valid"]
        df = events_txn(spark, d)
        if ok:
            row = strategy.analyse(df, preset).agg(F.count_if("is_anomaly").alias("flagged"))
        else:
            row = df.agg(F.max(F.lit(None).cast("long")).alias("flagged"))
        row = row.select(F.lit(name).alias("preset"), F.lit(ok).alias("valid"), "flagged")
        out = row if out is None else out.unionByName(row)
    return out


# -- listings ------------------------------------------------------------------


@query(
    "r01_list_transactions",
    f"""WITH {TXN} SELECT id, account_id, amount FROM txn WHERE amount BETWEEN 20 AND 80 AND account_id = '7'
    AND "timestamp" >= DATE '2024-01-03' AND "timestamp" < DATE '2024-01-21'""",
)
def r01(spark, d):
    found = serve.list_transactions(
        events_txn(spark, d), account_id="7", amount_min=20, amount_max=80,
        date_from="2024-01-03", date_to="2024-01-20",
    )
    return found.select("id", "account_id", "amount")


@query(
    "r02_search",
    f"""WITH {TXN} SELECT id, raw_data FROM txn WHERE raw_data ILIKE '%K": 4%'""",
)
def r02(spark, d):
    return serve.list_transactions(events_txn(spark, d), search='K": 4').select("id", "raw_data")


@query(
    "r03_page",
    f"""WITH {TXN} SELECT id, amount FROM txn ORDER BY amount DESC, id LIMIT 25 OFFSET 50""",
)
def r03(spark, d):
    found = serve.page(events_txn(spark, d), "amount", "desc", page=3, per_page=25)
    return found.select("id", "amount")


@query(
    "r03_page_after",
    f"""WITH {TXN} SELECT id, amount FROM txn WHERE amount < 50 OR (amount = 50 AND id > '5') OR amount IS NULL
      ORDER BY amount DESC NULLS LAST, id LIMIT 50""",
)
def r03_after(spark, d):
    found = serve.page_after(events_txn(spark, d), (50.0, "5"), "amount", "desc", 50)
    return found.select("id", "amount")


@query(
    "r03_far_page",
    f"""WITH {TXN} SELECT id, amount FROM txn ORDER BY amount DESC NULLS LAST, id LIMIT 20 OFFSET 780""",
)
def r03_far(spark, d):
    return serve.far_page(events_txn(spark, d), "amount", "desc", 40, 20).select("id", "amount")


@query(
    "r03_page_info",
    """SELECT count(*) AS total, 3 AS page, 25 AS per_page, count(*) > 75 AS has_next, true AS has_prev FROM events""",
)
def r03b(spark, d):
    return serve.page_info(events_txn(spark, d), 3, 25)


@query(
    "r04_more_filters",
    f"""WITH {zscore_sql()} SELECT id, category FROM txn WHERE category = 'purchase' AND isodow("timestamp") = 6
    AND id IN (SELECT id FROM zs WHERE score >= 0.7)""",
)
def r04(spark, d):
    df = events_txn(spark, d)
    flagged = strategy.analyse(df).filter("is_anomaly")
    found = serve.list_transactions(
        df, category="purchase", is_weekend=True, day_of_week=5, has_anomalies=True, flagged=flagged
    )
    return found.select("id", "category")


def _run(spark, d):
    """Stored-form scores and flags of one run of two detectors."""
    df = events_txn(spark, d)
    scores = strategy.run_strategy(df, TWO).withColumn("run_id", F.lit("run-1"))
    flags = tables.rule_flags(det.get("rule_based", "weekend_threshold").run(df), "run-1")
    return df, scores, flags


_FLAG_BASE = """fb AS (SELECT ft.id, ft.is_weekend, abs(ft.amount) AS a, ft.hour, g.thr AS gt, x.thr AS xt, coalesce(x.cnt, 0) AS cnt FROM ft
      JOIN gb g USING (id) JOIN ab x USING (id)),
    rf AS (SELECT id, is_weekend AND (a > gt * 0.3 OR (cnt >= 3 AND a > xt * 0.3)) AS r0, is_weekend AND (a > gt OR (cnt >= 3 AND a > xt)) AS r1,
      is_weekend AND (hour < 6 OR hour > 22) AS r2 FROM fb)"""


@query(
    "r05_transaction_details",
    f"""WITH {_TWO_SCORES}, {_FLAG_BASE} SELECT rf.id, round(greatest(zs.score, wk.score), 6) AS max_anomaly_score,
    concat_ws('; ', CASE WHEN wk.score >= 0.7 THEN 'rule_based.weekend_threshold' END, CASE WHEN zs.score >= 0.7 THEN 'statistical.zscore' END) AS algorithms,
    concat_ws('; ', CASE WHEN r0 THEN 'amount_threshold' END, CASE WHEN r2 THEN 'unusual_weekend_hour' END, CASE WHEN r1 THEN 'weekday_threshold' END) AS rules
    FROM rf LEFT JOIN zs USING (id) LEFT JOIN wk USING (id)""",
)
def r05(spark, d):
    df, scores, flags = _run(spark, d)
    return serve.transaction_details(df, scores, flags).select(
        "id",
        r6("max_anomaly_score").alias("max_anomaly_score"),
        joined("anomaly_algorithms_triggered").alias("algorithms"),
        joined("rule_flags_triggered").alias("rules"),
    )


@query(
    "r06_flagged_transactions",
    f"""WITH {_TWO_SCORES} SELECT txn.id, account_id, round(max(score), 6) AS anomaly_score FROM txn JOIN sc ON txn.id = sc.transaction_id
    WHERE score >= 0.8 AND algorithm_type = 'statistical' GROUP BY ALL ORDER BY max(score) DESC, txn.id LIMIT 40 OFFSET 40""",
)
def r06(spark, d):
    df, scores, _ = _run(spark, d)
    found = serve.flagged_transactions(df, scores, 0.8, "run-1", "statistical")
    return serve.page(found, "anomaly_score", "desc", 2, 40).select(
        "id", "account_id", r6("anomaly_score").alias("anomaly_score")
    )


@query(
    "r07_transaction_stats",
    f"""WITH {zscore_sql()} SELECT count(*) AS total_transactions, round(sum(amount), 4) AS total_amount, round(avg(amount), 6) AS average_amount,
    min(amount) AS min_amount, max(amount) AS max_amount, count(DISTINCT account_id) AS unique_accounts, epoch_us(min("timestamp")) AS date_range_start,
    epoch_us(max("timestamp")) AS date_range_end, (SELECT count(*) FROM zs WHERE score >= 0.7) AS anomaly_count,
    round((SELECT count(*) FROM zs WHERE score >= 0.7) / count(*), 6) AS anomaly_rate FROM txn""",
)
def r07(spark, d):
    df = events_txn(spark, d)
    found = serve.transaction_stats(df, strategy.analyse(df).filter("is_anomaly"))
    return found.withColumns(
        {
            "total_amount": F.round("total_amount", 4),
            "average_amount": r6("average_amount"),
            "anomaly_rate": r6("anomaly_rate"),
            "date_range_start": micros("date_range_start"),
            "date_range_end": micros("date_range_end"),
        }
    )


@query(
    "r07_by_day",
    f"""WITH {TXN} SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) AS transactions FROM txn GROUP BY 1""",
)
def r07b(spark, d):
    found = serve.transactions_by_day(events_txn(spark, d))
    return found.withColumn("day", F.col("day").cast("string"))


@query(
    "r07_by_category",
    f"""WITH {TXN} SELECT category, count(*) AS transactions FROM txn GROUP BY 1""",
)
def r07c(spark, d):
    return serve.transactions_by_category(events_txn(spark, d))


@query(
    "r08_account_summaries",
    f"""WITH {zscore_sql()}, an AS (SELECT account_id, count(*) AS hits FROM txn JOIN zs USING (id) WHERE score >= 0.7 GROUP BY 1)
    SELECT account_id, count(*) AS transaction_count, round(sum(amount), 4) AS total_amount, round(avg(amount), 8) AS average_amount,
    min(amount) AS min_amount, max(amount) AS max_amount, epoch_us(min("timestamp")) AS first_transaction,
    epoch_us(max("timestamp")) AS last_transaction, coalesce(any_value(hits), 0) AS anomalies_detected
    FROM txn LEFT JOIN an USING (account_id) GROUP BY account_id HAVING count(*) >= 60""",
)
def r08(spark, d):
    df = events_txn(spark, d)
    found = serve.account_summaries(df, 60, strategy.analyse(df).filter("is_anomaly"))
    return found.withColumns(
        {
            "total_amount": F.round("total_amount", 4),
            "average_amount": F.round("average_amount", 8),
            "first_transaction": micros("first_transaction"),
            "last_transaction": micros("last_transaction"),
        }
    )


@query(
    "r09_run_results",
    f"""WITH {_TWO_SCORES} SELECT transaction_id, algorithm_name, round(score, 6) AS score FROM sc WHERE score >= 0.7""",
)
def r09(spark, d):
    _, scores, _ = _run(spark, d)
    return serve.run_results(scores, "run-1").select(
        "transaction_id", "algorithm_name", r6("score").alias("score")
    )


@query(
    "r09_run_flags",
    f"""WITH {_TWO_SCORES}, {_FLAG_BASE} SELECT id AS transaction_id, 'amount_threshold' AS rule_name FROM rf WHERE r0
    UNION ALL SELECT id, 'weekday_threshold' FROM rf WHERE r1 UNION ALL SELECT id, 'unusual_weekend_hour' FROM rf WHERE r2""",
)
def r09b(spark, d):
    _, _, flags = _run(spark, d)
    return serve.run_flags(flags, "run-1").select("transaction_id", "rule_name")


_BEST = f"""{_TWO_SCORES}, be AS (SELECT transaction_id, max(score) AS score FROM sc GROUP BY 1)"""


@query(
    "r10_results_totals",
    f"""WITH {_BEST} SELECT count(*) AS total_transactions, count(*) FILTER (score >= 0.7) AS anomalous_transactions,
    round(100.0 * count(*) FILTER (score >= 0.7) / count(*), 6) AS anomaly_percentage FROM be""",
)
def r10(spark, d):
    _, scores, _ = _run(spark, d)
    return serve.results_totals(scores).withColumn("anomaly_percentage", r6("anomaly_percentage"))


@query(
    "r10_results_by_rule",
    f"""WITH {_TWO_SCORES}, {_FLAG_BASE} SELECT 'amount_threshold' AS rule_name, count(*) AS checked, count(*) FILTER (r0) AS triggered FROM rf
    UNION ALL SELECT 'weekday_threshold', count(*), count(*) FILTER (r1) FROM rf
    UNION ALL SELECT 'unusual_weekend_hour', count(*), count(*) FILTER (r2) FROM rf""",
)
def r10b(spark, d):
    _, _, flags = _run(spark, d)
    return serve.results_by_rule(flags)


@query(
    "r10_top_anomalies",
    f"""WITH {_BEST} SELECT transaction_id, round(score, 6) AS score FROM be ORDER BY be.score DESC, transaction_id LIMIT 10""",
)
def r10c(spark, d):
    _, scores, _ = _run(spark, d)
    return serve.top_anomalies(scores).withColumn("score", r6("score"))


@query(
    "r10_score_distribution",
    f"""WITH {_BEST} SELECT round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS std_score, round(min(score), 6) AS min_score,
    round(max(score), 6) AS max_score, {", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99))} FROM be""",
)
def r10d(spark, d):
    _, scores, _ = _run(spark, d)
    row = serve.score_distribution(scores)
    return row.select(*[r6(c).alias(c) for c in row.columns])


_STATUSES = UPLOAD_STATUSES[:4]


def _uploads(spark, d):
    """One upload per day of events, with a status by day of month."""
    df = events_txn(spark, d).withColumn("upload_id", F.date_format("timestamp", "yyyy-MM-dd"))
    day = F.dayofmonth("upload_timestamp")
    uploads = df.groupBy(F.col("upload_id").alias("id")).agg(
        F.min("timestamp").alias("upload_timestamp"),
        F.max("timestamp").alias("_last"),
        (F.count(F.lit(1)) * 100).alias("file_size"),
    )
    status = F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (day % 4 + 1).cast("int"))
    uploads = uploads.withColumn("status", status)
    done = F.when(F.col("status").isin("processed", "failed"), F.col("_last"))
    return df, uploads.withColumn("processed_at", done).drop("_last")


_UP = f"""{TXN}, up AS (SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS id, min("timestamp") AS upload_timestamp, max("timestamp") AS lst,
    count(*) * 100 AS file_size FROM txn GROUP BY 1),
  us AS (SELECT *, ['uploaded', 'processing', 'processed', 'failed'][day(upload_timestamp) % 4 + 1] AS status FROM up),
  ul AS (SELECT *, CASE WHEN status IN ('processed', 'failed') THEN lst END AS processed_at FROM us)"""


def _runs(spark, d):
    """One run per upload, its rate being the share of large amounts."""
    df, uploads = _uploads(spark, d)
    rates = df.groupBy("upload_id").agg(
        F.avg((F.col("amount") > 150).cast("double")).alias("anomaly_rate")
    )
    return uploads.join(rates.withColumnRenamed("upload_id", "id"), "id").select(
        F.concat(F.lit("run-"), "id").alias("id"),
        F.col("id").alias("upload_id"),
        F.lit("s-1").alias("strategy_id"),
        F.when(F.col("status") == "processed", "completed")
        .when(F.col("status") == "failed", "failed")
        .otherwise("running").alias("status"),
        F.col("upload_timestamp").alias("started_at"),
        F.col("processed_at").alias("completed_at"),
        "anomaly_rate",
    )


_RU = f"""{_UP}, ra AS (SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS id, avg(CASE WHEN amount > 150 THEN 1.0 ELSE 0.0 END) AS anomaly_rate
    FROM txn GROUP BY 1),
  ru AS (SELECT 'run-' || ul.id AS id, ul.id AS upload_id, CASE status WHEN 'processed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status,
    upload_timestamp AS started_at, processed_at AS completed_at, anomaly_rate FROM ul JOIN ra USING (id))"""


@query(
    "r11_list_runs",
    f"""WITH {_RU} SELECT id, upload_id, status, epoch_us(started_at) AS started FROM ru WHERE status = 'completed'
    ORDER BY started_at DESC LIMIT 3 OFFSET 3""",
)
def r11(spark, d):
    found = serve.list_runs(_runs(spark, d), status="completed", page_number=2, per_page=3)
    return found.select("id", "upload_id", "status", micros("started_at").alias("started"))


@query(
    "r12_list_uploads",
    f"""WITH {_UP} SELECT id, file_size, status FROM ul WHERE status = 'failed' ORDER BY upload_timestamp DESC LIMIT 5""",
)
def r12(spark, d):
    _, uploads = _uploads(spark, d)
    return serve.list_uploads(uploads, "failed", 1, 5).select("id", "file_size", "status")


@query(
    "r12_upload_stats",
    f"""WITH {_UP} SELECT count(*) AS total_uploads, count(*) FILTER (status = 'processed') AS successful_uploads,
    count(*) FILTER (status = 'failed') AS failed_uploads, count(*) FILTER (status IN ('uploaded', 'processing')) AS processing_uploads,
    CAST(sum(file_size) AS BIGINT) AS total_size_bytes FROM ul""",
)
def r12b(spark, d):
    return serve.upload_stats(_uploads(spark, d)[1])


@query(
    "r13_processing_stats",
    f"""WITH {_UP} SELECT count(*) AS total_uploads, CAST(sum(file_size) AS BIGINT) AS total_file_size_bytes,
    round(avg((epoch_us(processed_at) - epoch_us(upload_timestamp)) / 1000000.0), 4) AS average_processing_time_seconds,
    (SELECT count(*) FROM txn) AS total_transactions_processed FROM ul""",
)
def r13(spark, d):
    df, uploads = _uploads(spark, d)
    return serve.processing_stats(uploads, df).withColumn(
        "average_processing_time_seconds", F.round("average_processing_time_seconds", 4)
    )


@query("r13_status_counts", f"WITH {_UP} SELECT status, count(*) AS count FROM ul GROUP BY 1")
def r13b(spark, d):
    return serve.status_counts(_uploads(spark, d)[1])


@query(
    "r14_run_stats",
    f"""WITH {_RU} SELECT count(*) AS total_analyses, round(avg((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0), 4)
    AS average_execution_time_seconds, round(avg(anomaly_rate), 6) AS average_anomaly_rate FROM ru""",
)
def r14(spark, d):
    return serve.run_stats(_runs(spark, d)).withColumns(
        {
            "average_execution_time_seconds": F.round("average_execution_time_seconds", 4),
            "average_anomaly_rate": r6("average_anomaly_rate"),
        }
    )


@query(
    "r15_retention",
    f"""WITH {_UP} SELECT txn.id FROM txn JOIN ul ON CAST(CAST(txn."timestamp" AS DATE) AS VARCHAR) = ul.id
    WHERE NOT upload_timestamp < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY""",
)
def r15(spark, d):
    df, uploads = _uploads(spark, d)
    return serve.retention(uploads, df, "2024-02-10").select("id")


@query(
    "r15_removed",
    f"""WITH {_UP} SELECT txn.id FROM txn JOIN ul ON CAST(CAST(txn."timestamp" AS DATE) AS VARCHAR) = ul.id
    WHERE NOT upload_timestamp < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY""",
)
def r15_removed(spark, d):
    """What is left in the stored table; a second run finds nothing more to remove."""
    df, uploads = _uploads(spark, d)
    path = scratch(spark, "stored")
    tables.write_transactions(df, path)
    serve.remove_expired(spark, uploads, path, "2024-02-10")
    if serve.remove_expired(spark, uploads, path, "2024-02-10"):
        raise AssertionError("a partition was removed twice")
    return tables.load_transactions(spark, path).select("id")


@query(
    "r15_run_retention",
    f"""WITH {_RU} SELECT id FROM ru WHERE NOT coalesce(completed_at < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY, false)""",
)
def r15b(spark, d):
    return serve.run_retention(_runs(spark, d), "2024-04-15").select("id")


# -- views ---------------------------------------------------------------------


def _pair(spark, d):
    df = events_txn(spark, d)
    return df, strategy.analyse(df)


@query(
    "u01_daily_timeline",
    f"""WITH {zscore_sql()} SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) FILTER (score >= 0.7) AS anomalies,
    count(*) AS transactions FROM txn LEFT JOIN zs USING (id) GROUP BY 1""",
)
def u01(spark, d):
    return views.daily_timeline(*_pair(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(
    "u02_recent_flagged",
    f"""WITH {zscore_sql()} SELECT id, account_id, amount, round(score, 6) AS final_score FROM txn JOIN zs USING (id) WHERE score >= 0.7
    ORDER BY "timestamp" DESC, id LIMIT 20""",
)
def u02(spark, d):
    return views.recent_flagged(*_pair(spark, d), k=20).select(
        "id", "account_id", "amount", r6("final_score").alias("final_score")
    )


@query(
    "u03_weekly_kpis",
    f"""WITH {zscore_sql()}, k AS (SELECT (epoch_us(TIMESTAMP '2024-01-29') - epoch_us("timestamp")) / 604800000000.0 AS age, amount,
      CASE WHEN score >= 0.7 THEN score END AS hit FROM txn LEFT JOIN zs USING (id)),
    a AS (SELECT count(*) FILTER (age >= 0 AND age < 1) AS t1, count(*) FILTER (age >= 1 AND age < 2) AS t2,
      count(hit) FILTER (age >= 0 AND age < 1) AS f1, count(hit) FILTER (age >= 1 AND age < 2) AS f2,
      sum(abs(amount)) FILTER (hit IS NOT NULL AND age >= 0 AND age < 1) AS l1, sum(abs(amount)) FILTER (hit IS NOT NULL AND age >= 1 AND age < 2) AS l2,
      10 * avg(hit) FILTER (age >= 0 AND age < 1) AS r1, 10 * avg(hit) FILTER (age >= 1 AND age < 2) AS r2 FROM k)
    SELECT f1 AS flagged_transactions, round(100.0 * (f1 - f2) / f2, 6) AS flagged_transactions_change, t1 AS total_transactions,
      round(100.0 * (t1 - t2) / t2, 6) AS total_transactions_change, round(l1, 4) AS potential_loss,
      round(100.0 * (l1 - l2) / l2, 6) AS potential_loss_change, round(r1, 6) AS risk_score, round(100.0 * (r1 - r2) / r2, 6) AS risk_score_change FROM a""",
)
def u03(spark, d):
    row = views.weekly_kpis(*_pair(spark, d), as_of="2024-01-29")
    rounded = [c for c in row.columns if c.endswith("_change") or c == "risk_score"]
    return row.withColumns({c: r6(c) for c in rounded}).withColumn(
        "potential_loss", F.round("potential_loss", 4)
    )


@query(
    "u04_account_statistics",
    f"""WITH {zscore_sql()} SELECT account_id, count(*) FILTER (score >= 0.7) AS anomalies, count(*) AS transactions,
    round(count(*) FILTER (score >= 0.7) / count(*), 6) AS anomaly_rate FROM txn LEFT JOIN zs USING (id) GROUP BY 1""",
)
def u04(spark, d):
    return views.account_statistics(*_pair(spark, d)).withColumn("anomaly_rate", r6("anomaly_rate"))


_TOP = """top AS (SELECT account_id, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, account_id LIMIT {0}),
    ra AS (SELECT account_id, row_number() OVER (ORDER BY n DESC, account_id) AS rk FROM top)""".format


@query(
    "u05_account_time_series",
    f"""WITH {TXN}, {_TOP(5)} SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day,
    {", ".join(f"count(*) FILTER (rk = {k}) AS account_{k}" for k in range(1, 6))} FROM txn JOIN ra USING (account_id) GROUP BY 1""",
)
def u05(spark, d):
    found = views.account_time_series(events_txn(spark, d), 5)
    day, *accounts = found.columns
    return found.select(
        F.col(day).cast("string").alias("day"),
        *[F.col(f"`{a}`").alias(f"account_{i + 1}") for i, a in enumerate(accounts)],
    )


@query(
    "u06_account_correlation",
    f"""WITH {TXN.replace("FROM events", "FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-31'")}, {_TOP(8)},
    da AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
    de AS (SELECT day, ra.account_id, count(txn.id) AS c FROM da CROSS JOIN ra LEFT JOIN txn ON txn.account_id = ra.account_id
      AND CAST(txn."timestamp" AS DATE) = day GROUP BY ALL)
    SELECT a.account_id AS account_a, b.account_id AS account_b, round(covar_pop(a.c, b.c) / nullif(stddev_pop(a.c) * stddev_pop(b.c), 0), 6) AS correlation
    FROM de a JOIN de b USING (day) GROUP BY ALL""",
)
def u06(spark, d):
    found = views.account_correlation(events_txn(spark, d), "2024-01-30", 30, 8)
    return found.withColumn("correlation", r6("correlation"))


# -- extension surface and streams ----------------------------------------------


class RoundAmountDetector(det.Detector):
    """Example plug-in: whole amounts are suspicious."""

    type = "rule_based"
    name = "round_amount"
    description = "Amounts without cents"
    default_config = {"score": 0.9}

    def detect(self, txns, config):
        whole = F.col("amount") == F.floor("amount")
        return det.base.scored(
            txns.df, F.when(whole, float(config["score"])).otherwise(0.1), F.lit(1.0), {"whole": whole}
        )


@query(
    "e01_custom_detector",
    """SELECT CAST(event_id AS VARCHAR) AS transaction_id, CASE WHEN value = floor(value) THEN 0.8 ELSE 0.1 END AS score FROM events""",
)
def e01(spark, d):
    return RoundAmountDetector().run(events_txn(spark, d), {"score": 0.8}).select(
        "transaction_id", "score"
    )


@query(
    "e02_registry",
    """SELECT 'round_amount' AS algorithm_name, count(*) FILTER (value = floor(value)) AS found, count(*) AS scored FROM events""",
)
def e02(spark, d):
    """A registered plug-in runs in a strategy like any other detector."""
    plug_in = det.register(RoundAmountDetector())
    plan = {"algorithms": [_spec("rule_based", "round_amount")]}
    try:
        log = detector_log(strategy.run_strategy(events_txn(spark, d), plan))
    finally:
        det.unregister(plug_in.type, plug_in.name)
    return log.select(
        "algorithm_name",
        F.col("anomalies_found").alias("found"),
        F.col("transactions_analyzed").alias("scored"),
    )


@query(
    "st1_stream_ingest",
    f"""WITH {TXN} SELECT id, account_id, amount, epoch_us(date_trunc('second', "timestamp")) AS micros, CAST(hour("timestamp") AS INTEGER) AS hour FROM txn""",
)
def st1(spark, d):
    landing, out = scratch(spark, "landing"), scratch(spark, "stored")
    text = events_txn(spark, d).select(
        "id",
        F.col("account_id").alias("konto"),
        F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss").alias("datum"),
        F.concat(F.lit("€"), F.format_number("amount", 2)).alias("belopp"),
    )
    text.write.csv(landing, header=True)
    start_ingest(spark, landing, out, scratch(spark, "progress"), text.schema).awaitTermination()
    return tables.load_transactions(spark, out).select(
        "id", "account_id", "amount", micros("timestamp").alias("micros"), "hour"
    )


@query(
    "st2_stream_facts",
    "SELECT count(*) AS n, true AS same FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
)
def st2_facts(spark, d):
    """A stream gives every arriving row the score that a batch gives it."""
    df = events_txn(spark, d)
    later = df.filter(F.col("timestamp") >= "2024-01-15")
    model = det.get("ml_based", "isolation_forest").fit(
        df.filter(F.col("timestamp") < "2024-01-15"), {"n_estimators": 25}
    )
    arriving, out = scratch(spark, "arriving"), scratch(spark, "scored")
    later.write.parquet(arriving)
    stream = spark.readStream.schema(df.schema).parquet(arriving)
    start_scoring(model, stream, out, scratch(spark, "progress")).awaitTermination()
    streamed = spark.read.parquet(out).select("transaction_id", F.col("score").alias("other"))
    batch = det.get("ml_based", "isolation_forest").score(model, later).select("transaction_id", "score")
    both = batch.join(streamed, "transaction_id", "full_outer")
    far = F.max(F.coalesce(F.abs(F.col("score") - F.col("other")), F.lit(1.0)))
    return both.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(far, F.lit(0.0)) < 1e-9).alias("same"))


@query("st2_stream_score")
def st2(spark, d):
    df = events_txn(spark, d)
    early = df.filter(F.col("timestamp") < "2024-01-15")
    model = det.get("ml_based", "isolation_forest").fit(early, {"n_estimators": 25})
    arriving, out = scratch(spark, "arriving"), scratch(spark, "scored")
    df.filter(F.col("timestamp") >= "2024-01-15").write.parquet(arriving)
    stream = spark.readStream.schema(df.schema).parquet(arriving)
    scored = score_stream(model, stream).select("transaction_id", "score", "confidence")
    (
        scored.writeStream.option("checkpointLocation", scratch(spark, "progress"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
        .awaitTermination()
    )
    return spark.read.parquet(out).select("transaction_id", r6("score").alias("score"))
