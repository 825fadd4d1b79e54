"""Queries for record validation, quality scores and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddledger.catalog.common import FEATS, TXN, events_txn, joined, micros, orders_txn, r6, table
from oddledger.operators import profile as p
from oddledger.operators import quality as q
from oddledger.operators import transform as t
from oddledger.operators import validate as v

QUERIES: dict = {}
SQL: dict = {}
NOW = "2024-01-20 00:00:00"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _dirty(spark, d):
    """Raw text records with every kind of flaw, by event number."""
    key = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        F.lit("events").alias("_source_file"),
        (key + 1).alias("_row_number"),
        F.when(key % 17 == 0, "").when(key % 19 == 0, F.repeat(F.lit("x"), F.lit(101)))
        .otherwise(key.cast("string")).alias("id"),
        F.when(key % 7 == 0, F.lit(None))
        .when(key % 7 == 1, "12x-3")
        .when(key % 7 == 2, "0.00")
        .when(key % 7 == 3, F.concat(F.lit("-"), F.col("value").cast("string")))
        .when(key % 7 == 4, "$2000000")
        .when(key % 7 == 5, "1.2345")
        .otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(key % 11 == 0, "soon")
        .when(key % 11 == 1, "1999-12-31")
        .when(key % 11 == 2, F.date_format(at, "dd/MM/yyyy"))
        .otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(key % 13 == 0, " ")
        .when(key % 13 == 1, "Demo")
        .when(key % 13 == 2, "a")
        .when(key % 13 == 3, F.repeat(F.lit("b"), F.lit(51)))
        .otherwise(F.concat(F.lit("ACC"), F.col("user_id"))).alias("account_id"),
        F.when(key % 5 == 0, "  ")
        .when(key % 5 == 1, "A Sample row")
        .when(key % 5 == 2, F.repeat(F.lit("d"), F.lit(1001)))
        .otherwise(F.col("event_type")).alias("description"),
    )


_DIRTY = """raw AS (SELECT event_id, ts,
   CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN repeat('x', 101) ELSE CAST(event_id AS VARCHAR) END AS id,
   CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '12x-3' WHEN 2 THEN '0.00' WHEN 3 THEN '-' || CAST(value AS VARCHAR)
     WHEN 4 THEN '$2000000' WHEN 5 THEN '1.2345' ELSE CAST(value AS VARCHAR) END AS amount,
   CASE event_id % 11 WHEN 0 THEN 'soon' WHEN 1 THEN '1999-12-31' WHEN 2 THEN strftime(ts, '%d/%m/%Y')
     ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS tstext,
   CASE event_id % 13 WHEN 0 THEN ' ' WHEN 1 THEN 'Demo' WHEN 2 THEN 'a' WHEN 3 THEN repeat('b', 51)
     ELSE 'ACC' || user_id END AS account_id,
   CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'A Sample row' WHEN 2 THEN repeat('d', 1001) ELSE event_type END AS description
  FROM events),
 parsed AS (SELECT *, try_strptime(tstext, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d/%m/%Y']) AS t,
   TRY_CAST(regexp_replace(amount, '[^0-9.-]', '', 'g') AS DOUBLE) AS a,
   regexp_replace(amount, '[^0-9.-]', '', 'g') AS cleaned FROM raw)"""

_AMOUNT_E = """CASE WHEN a IS NULL THEN 'amount.unreadable: ' || amount END"""
_AMOUNT_W = """CASE WHEN a = 0 THEN 'amount.zero' WHEN a < 0 THEN 'amount.negative'
   WHEN a > 1000000 THEN 'amount.large' END,
   CASE WHEN a IS NOT NULL AND length(regexp_extract(cleaned, '\\.([0-9]*)$', 1)) > 2 THEN 'amount.fraction' END"""
_TIME_E = "CASE WHEN t IS NULL THEN 'timestamp.unreadable: ' || tstext END"
_TIME_W = f"""CASE WHEN t > TIMESTAMP '{NOW}' THEN 'timestamp.future'
   WHEN year(t) < 2000 THEN 'timestamp.old' END"""
_ACCOUNT_E = "CASE WHEN trim(account_id) = '' THEN 'account.empty' END"
_ACCOUNT_W = """CASE WHEN trim(account_id) <> '' AND length(trim(account_id)) < 3 THEN 'account.short'
   WHEN length(trim(account_id)) > 50 THEN 'account.long' END,
   CASE WHEN lower(trim(account_id)) IN ('test', 'demo', 'example') THEN 'account.test' END"""
_ID_W = """CASE WHEN trim(id) = '' THEN 'id.empty' WHEN length(trim(id)) > 100 THEN 'id.long' END"""
_DESC_W = """CASE WHEN trim(description) = '' THEN 'description.empty' WHEN length(trim(description)) > 1000 THEN 'description.long' END,
   CASE WHEN regexp_matches(lower(description), 'test|dummy|fake|sample') THEN 'description.test' END"""
_REQ = "amount IS NULL"
_ROWS = f"""{_DIRTY}, checked AS (SELECT *,
   CASE WHEN {_REQ} THEN 'field.null: amount' ELSE concat_ws('; ', {_AMOUNT_E}, {_TIME_E}, {_ACCOUNT_E}) END AS errors,
   CASE WHEN {_REQ} THEN '' ELSE concat_ws('; ', {_AMOUNT_W}, {_TIME_W}, {_ACCOUNT_W}, {_ID_W}, {_DESC_W}) END AS warnings FROM parsed)"""


def _matching(column: str, words: str, sql_words: str):
    """Validated rows whose messages are about one field."""
    sql = f"""WITH {_ROWS}, hits AS (SELECT event_id, list_filter(string_split({column}, '; '),
      lambda m: regexp_matches(m, '{sql_words}')) AS h FROM checked)
      SELECT event_id, list_aggregate(h, 'string_agg', '; ') AS found FROM hits WHERE len(h) > 0"""

    def run(spark, d):
        rows = v.validate_rows(_dirty(spark, d), NOW)
        hits = F.filter(column, lambda m: m.rlike(words))
        return rows.filter(F.size(hits) > 0).select(
            (F.col("_row_number") - 1).alias("event_id"), joined(hits).alias("found")
        )

    return run, sql


for _name, _column, _words in [
    ("v01_required_fields", "errors", "^field"),
    ("v02_amount_errors", "errors", "^amount"),
    ("v02_amount_warnings", "warnings", "^amount"),
    ("v03_timestamp_errors", "errors", "^timestamp"),
    ("v03_timestamp_warnings", "warnings", "^timestamp"),
    ("v04_account_errors", "errors", "^account"),
    ("v04_account_warnings", "warnings", "^account"),
    ("v05_transaction_id", "warnings", "^id"),
    ("v06_description", "warnings", "^description"),
]:
    QUERIES[_name], SQL[_name] = _matching(_column, _words, _words)


@query(
    "v07_batch_counts",
    f"""WITH {_ROWS} SELECT count(*) AS total_transactions, count(*) FILTER (errors = '') AS valid_transactions,
    count(*) FILTER (errors <> '') AS invalid_transactions,
    CAST(sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '; ')) END) AS BIGINT) AS row_error_count,
    CAST(sum(CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '; ')) END) AS BIGINT) AS row_warning_count,
    round(count(*) FILTER (errors = '') / count(*), 6) AS validation_rate FROM checked""",
)
def v07(spark, d):
    return v.batch_counts(_dirty(spark, d), NOW).withColumn(
        "validation_rate", r6("validation_rate")
    )


@query(
    "v08_batch_consistency",
    f"""WITH {_ROWS}, o AS (SELECT t < lag(t) OVER (ORDER BY event_id) AS back FROM parsed WHERE t IS NOT NULL)
    SELECT count(nullif(id, '')) <> count(DISTINCT nullif(id, '')) AS duplicate_ids, (SELECT bool_or(back) FROM o) AS out_of_order,
      count(DISTINCT account_id) = 1 AND count(*) > 100 AS single_account,
      CASE WHEN count(nullif(id, '')) <> count(DISTINCT nullif(id, '')) THEN 'batch.repeated_ids' ELSE '' END AS batch_errors,
      concat_ws('; ', CASE WHEN (SELECT bool_or(back) FROM o) THEN 'batch.unordered' END,
        CASE WHEN count(DISTINCT account_id) = 1 AND count(*) > 100 THEN 'batch.one_account' END) AS batch_warnings
    FROM parsed""",
)
def v08(spark, d):
    return v.batch_consistency(_dirty(spark, d)).withColumns(
        {"batch_errors": joined("batch_errors"), "batch_warnings": joined("batch_warnings")}
    )


@query(
    "v08_input_order",
    """WITH o AS (SELECT epoch_us(ts) < lag(epoch_us(ts)) OVER (ORDER BY event_id) AS back FROM events)
    SELECT coalesce(bool_or(back), false) AS out_of_order FROM o""",
)
def v08b(spark, d):
    e = table(spark, d, "events").select(
        F.lit("events").alias("_source_file"),
        (F.col("event_id") + 1).alias("_row_number"),
        F.col("ts").alias("timestamp"),
    )
    return v.out_of_order(e)


@query(
    "v09_batch_summary",
    f"""WITH {_DIRTY}, n AS (SELECT CASE WHEN regexp_matches(trim(amount), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')
      THEN TRY_CAST(amount AS DOUBLE) END AS v, account_id, t FROM parsed)
    SELECT min(v) AS amount_min, max(v) AS amount_max, round(avg(v), 6) AS amount_avg, count(v) AS amount_count,
      count(DISTINCT account_id) AS unique_accounts, epoch_us(min(t)) AS date_start, epoch_us(max(t)) AS date_end,
      CAST(floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000) AS BIGINT) AS span_days FROM n""",
)
def v09(spark, d):
    return v.batch_summary(_dirty(spark, d)).withColumns(
        {
            "amount_avg": r6("amount_avg"),
            "date_start": micros("date_start"),
            "date_end": micros("date_end"),
        }
    )


def _gappy(spark, d):
    """Typed rows with holes, repeats, negative and future values."""
    key = F.col("event_id")
    return table(spark, d, "events").select(
        F.floor(key / 2).cast("string").alias("id"),
        F.when(key % 9 != 0, F.round(F.col("value") - 50, 2)).alias("amount"),
        F.when(key % 10 != 0, F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(key % 4 != 0, F.col("user_id").cast("string")).alias("account_id"),
        F.col("event_type").alias("category"),
    )


_GAPPY = """g AS (SELECT CAST(event_id // 2 AS VARCHAR) AS id, CASE WHEN event_id % 9 <> 0 THEN round(value - 50, 2) END AS amount,
   CASE WHEN event_id % 10 <> 0 THEN ts END AS t, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS account_id,
   event_type AS category FROM events)"""
_CELLS = """c AS (SELECT count(*) AS n, count(*) - count(amount) AS ma, count(*) - count(t) AS mt,
   count(*) - count(account_id) AS mc FROM g)"""
_RATE = "(5.0 * n - ma - mt - mc) / (5.0 * n)"
_COMPLETE_ISSUES = f"""concat_ws('; ', CASE WHEN {_RATE} < 0.95 THEN printf('completeness: %.1f%%', 100 * {_RATE}) END,
   CASE WHEN ma > 0 THEN printf('missing.amount: %.1f%%', 100.0 * ma / n) END,
   CASE WHEN mt > 0 THEN printf('missing.timestamp: %.1f%%', 100.0 * mt / n) END,
   CASE WHEN mc > 0 THEN printf('missing.account_id: %.1f%%', 100.0 * mc / n) END)"""


@query(
    "q01_completeness",
    f"""WITH {_GAPPY}, {_CELLS} SELECT round({_RATE}, 6) AS completeness_score, ma + mt + mc AS missing_values,
    {_COMPLETE_ISSUES} AS completeness_issues FROM c""",
)
def q01(spark, d):
    return q.check_completeness(_gappy(spark, d)).withColumns(
        {
            "completeness_score": r6("completeness_score"),
            "completeness_issues": joined("completeness_issues"),
        }
    )


@query(
    "q02_consistency",
    f"""WITH {_DIRTY}, n AS (SELECT count(*) FILTER (t IS NULL) AS bt, count(*) FILTER (amount IS NULL OR NOT
      regexp_matches(amount, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')) AS ba FROM parsed)
    SELECT bt AS bad_timestamps, ba AS bad_amounts, round((CASE WHEN bt > 0 THEN 0.9 ELSE 1.0 END)
      * (CASE WHEN ba > 0 THEN 0.9 ELSE 1.0 END), 6) AS consistency_score,
      concat_ws('; ', CASE WHEN bt > 0 THEN 'unreadable_timestamps: ' || bt END,
        CASE WHEN ba > 0 THEN 'unreadable_amounts: ' || ba END) AS consistency_issues FROM n""",
)
def q02(spark, d):
    return q.check_consistency(_dirty(spark, d)).withColumns(
        {
            "consistency_score": r6("consistency_score"),
            "consistency_issues": joined("consistency_issues"),
        }
    )


@query(
    "q03_validity",
    f"""WITH {_GAPPY}, n AS (SELECT count(*) FILTER (amount < 0) AS neg, count(*) FILTER (t > TIMESTAMP '{NOW}') AS late FROM g)
    SELECT neg AS negative_amounts, late AS future_timestamps, round((CASE WHEN neg > 0 THEN 0.95 ELSE 1.0 END)
      * (CASE WHEN late > 0 THEN 0.98 ELSE 1.0 END), 6) AS validity_score,
      concat_ws('; ', CASE WHEN neg > 0 THEN 'negative_amounts: ' || neg END,
        CASE WHEN late > 0 THEN 'future_timestamps: ' || late END) AS validity_issues FROM n""",
)
def q03(spark, d):
    return q.check_validity(_gappy(spark, d), NOW).withColumns(
        {"validity_score": r6("validity_score"), "validity_issues": joined("validity_issues")}
    )


_DUPES = """dup AS (SELECT (SELECT count(*) FROM g) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS dr,
   (SELECT count(*) - count(DISTINCT id) FROM g) AS di)"""


@query(
    "q04_uniqueness",
    f"""WITH {_GAPPY}, {_DUPES} SELECT dr AS duplicate_rows, di AS duplicate_id,
      round((CASE WHEN dr > 0 THEN 0.9 ELSE 1.0 END) * (CASE WHEN di > 0 THEN 0.9 ELSE 1.0 END), 6) AS uniqueness_score,
      concat_ws('; ', CASE WHEN dr > 0 THEN 'repeated_rows: ' || dr END,
        CASE WHEN di > 0 THEN 'repeated_id: ' || di END) AS uniqueness_issues FROM dup""",
)
def q04(spark, d):
    return q.check_uniqueness(_gappy(spark, d)).withColumns(
        {"uniqueness_score": r6("uniqueness_score"), "uniqueness_issues": joined("uniqueness_issues")}
    )


@query(
    "q05_quality_report",
    f"""WITH {_GAPPY}, {_CELLS}, {_DUPES}, s AS (SELECT n AS rows, {_RATE} AS cs,
      (CASE WHEN mt > 0 THEN 0.9 ELSE 1.0 END) * (CASE WHEN ma > 0 THEN 0.9 ELSE 1.0 END) AS ks,
      CASE WHEN (SELECT count(*) FROM g WHERE amount < 0) > 0 THEN 0.95 ELSE 1.0 END
        * CASE WHEN (SELECT count(*) FROM g WHERE t > TIMESTAMP '{NOW}') > 0 THEN 0.98 ELSE 1.0 END AS vs,
      CASE WHEN dr > 0 THEN 0.9 ELSE 1.0 END * CASE WHEN di > 0 THEN 0.9 ELSE 1.0 END AS us, dr FROM c, dup)
    SELECT rows, round(cs, 6) AS completeness_score, round(ks, 6) AS consistency_score, round(vs, 6) AS validity_score,
      round(us, 6) AS uniqueness_score, round((cs + ks + vs + us) / 4, 6) AS quality_score,
      CASE WHEN (cs + ks + vs + us) / 4 >= 0.8 THEN 'excellent' WHEN (cs + ks + vs + us) / 4 >= 0.6 THEN 'good'
        WHEN (cs + ks + vs + us) / 4 >= 0.4 THEN 'fair' ELSE 'poor' END AS overall_quality,
      concat_ws('; ', CASE WHEN cs < 0.95 THEN 'fill_missing' END,
        CASE WHEN dr > 0 THEN 'drop_repeated' END) AS recommendations FROM s""",
)
def q05(spark, d):
    row = q.quality_report(_gappy(spark, d), NOW)
    scores = [c for c in row.columns if c.endswith("_score")]
    return row.select(
        "rows",
        *[r6(c).alias(c) for c in scores],
        "overall_quality",
        joined("recommendations").alias("recommendations"),
    )


@query(
    "p01_missing_values",
    f"""WITH {_GAPPY}, m AS (SELECT count(*) AS n, count(id) AS id, count(amount) AS amount, count(t) AS "timestamp",
      count(account_id) AS account_id, count(category) AS category FROM g),
    u AS (UNPIVOT m ON id, amount, "timestamp", account_id, category INTO NAME "column" VALUE v)
    SELECT "column", 'missing_count' AS metric, CAST(n - v AS DOUBLE) AS value FROM u
    UNION ALL SELECT "column", 'missing_percent', round(100.0 * (n - v) / n, 6) FROM u""",
)
def p01(spark, d):
    return p.missing_values(_gappy(spark, d)).withColumn("value", r6("value"))


@query(
    "p02_duplicates",
    f"""WITH {TXN}, x AS (SELECT account_id, category, round(amount / 10) * 10 AS amount FROM txn)
    SELECT account_id, category, round(amount, 6) AS amount, count(*) AS copies FROM x GROUP BY ALL HAVING count(*) > 1""",
)
def p02(spark, d):
    df = events_txn(spark, d).select(
        "account_id", "category", (F.round(F.col("amount") / 10) * 10).alias("amount")
    )
    return p.duplicate_records(df).withColumn("amount", r6("amount"))


@query(
    "p02_duplicate_summary",
    f"""WITH {TXN}, x AS (SELECT account_id, category, CAST(round(amount / 10) AS BIGINT) AS tens FROM txn),
    k AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS u FROM x)
    SELECT n AS rows, n - u AS duplicate_count, round(100.0 * (n - u) / n, 6) AS duplicate_percent FROM k""",
)
def p02b(spark, d):
    df = events_txn(spark, d).select(
        "account_id", "category", F.round(F.col("amount") / 10).cast("long").alias("tens")
    )
    return p.duplicate_summary(df).withColumn("duplicate_percent", r6("duplicate_percent"))


@query(
    "p03_type_compliance",
    f"""WITH {_DIRTY} SELECT 'amount' AS "column", 'violations' AS metric,
      CAST(count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS DOUBLE) AS value FROM raw
    UNION ALL SELECT 'amount', 'values', CAST(count(amount) AS DOUBLE) FROM raw
    UNION ALL SELECT 'timestamp', 'violations', CAST(count(*) FILTER (tstext = 'soon' OR tstext LIKE '%/%') AS DOUBLE) FROM raw
    UNION ALL SELECT 'timestamp', 'values', CAST(count(tstext) AS DOUBLE) FROM raw""",
)
def p03(spark, d):
    return p.type_compliance(_dirty(spark, d), {"amount": "double", "timestamp": "timestamp"})


_BOUNDS = """b AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM txn)"""


@query(
    "p04_numeric_outliers",
    f"""WITH {TXN}, {_BOUNDS} SELECT id, amount, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6)
    AS upper_bound FROM txn, b WHERE amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)""",
)
def p04(spark, d):
    return p.numeric_outliers(events_txn(spark, d), "amount").select(
        "id", "amount", r6("lower_bound").alias("lower_bound"), r6("upper_bound").alias("upper_bound")
    )


@query(
    "p05_range_violations",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'amount' AS "column", value FROM events WHERE value < 1 OR value > 200
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id > 100""",
)
def p05(spark, d):
    df = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("value").alias("amount"), "user_id"
    )
    return p.range_violations(df, {"amount": (1, 200), "user_id": (None, 100)})


@query(
    "p06_rule_compliance",
    f"""WITH {_GAPPY} SELECT 'signed' AS rule, count(*) FILTER (NOT coalesce(amount <> 0, false)) AS violations,
      round(1 - count(*) FILTER (NOT coalesce(amount <> 0, false)) / count(*), 6) AS compliance FROM g
    UNION ALL SELECT 'purchase_is_credit', count(*) FILTER (NOT coalesce(category <> 'purchase' OR amount > 0, false)),
      round(1 - count(*) FILTER (NOT coalesce(category <> 'purchase' OR amount > 0, false)) / count(*), 6) FROM g""",
)
def p06(spark, d):
    rules = {
        "signed": F.col("amount") != 0,
        "purchase_is_credit": (F.col("category") != "purchase") | (F.col("amount") > 0),
    }
    return p.rule_compliance(_gappy(spark, d), rules).withColumn("compliance", r6("compliance"))


@query(
    "p07_reversed_times",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
)
def p07(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("processed_at")
    )
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("created_at")
    )
    return p.reversed_times(li.join(o, "l_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "p07_steps_back",
    """WITH s AS (SELECT o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM s WHERE o_orderdate < p""",
)
def p07b(spark, d):
    found = p.steps_back(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate")
    return found.select("o_orderkey")


@query(
    "p08_time_gaps",
    f"""WITH {TXN}, g AS (SELECT id, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY account_id
      ORDER BY "timestamp", id)) / 3600000000.0 AS h FROM txn) SELECT id, round(h, 6) AS gap_hours FROM g WHERE h > 24""",
)
def p08(spark, d):
    return p.time_gaps(events_txn(spark, d), "account_id", "timestamp", 24).select(
        "id", r6("gap_hours").alias("gap_hours")
    )


@query(
    "p08_time_checks",
    f"""WITH {TXN} SELECT epoch_us(min("timestamp")) AS first_time, epoch_us(max("timestamp")) AS last_time,
    count(*) FILTER ("timestamp" > TIMESTAMP '{NOW}') AS future_count FROM txn""",
)
def p08b(spark, d):
    return p.time_checks(events_txn(spark, d), "timestamp", NOW).withColumns(
        {"first_time": micros("first_time"), "last_time": micros("last_time")}
    )


@query(
    "p09_suspicious_accounts",
    """SELECT CAST(o_custkey AS VARCHAR) AS account_id, count(*) AS transaction_count, min(floor(o_totalprice / 200000)) AS amount
    FROM orders GROUP BY o_custkey HAVING min(floor(o_totalprice / 200000)) = max(floor(o_totalprice / 200000)) AND count(*) >= 5""",
)
def p09(spark, d):
    coarse = orders_txn(spark, d).withColumn(
        "amount", F.floor(F.col("amount") / 200000).cast("double")
    )
    return p.suspicious_accounts(coarse)


@query(
    "p10_schema_compliance",
    f"""WITH {_DIRTY}, n AS (SELECT TRY_CAST(amount AS DOUBLE) AS v, * FROM raw)
    SELECT 'amount' AS "column", 'null_required' AS metric, CAST(count(*) FILTER (amount IS NULL) AS DOUBLE) AS value FROM n
    UNION ALL SELECT 'amount', 'type', CAST(count(*) FILTER (amount IS NOT NULL AND v IS NULL) AS DOUBLE) FROM n
    UNION ALL SELECT 'amount', 'below_min', CAST(count(*) FILTER (v < -100) AS DOUBLE) FROM n
    UNION ALL SELECT 'amount', 'above_max', CAST(count(*) FILTER (v > 100) AS DOUBLE) FROM n
    UNION ALL SELECT 'account_id', 'null_required', CAST(count(*) FILTER (account_id IS NULL) AS DOUBLE) FROM n
    UNION ALL SELECT 'account_id', 'pattern', CAST(count(*) FILTER (NOT regexp_matches(account_id, '^ACC[0-9]{{3}}$')) AS DOUBLE) FROM n
    UNION ALL SELECT 'currency', 'missing_column', CAST(count(*) AS DOUBLE) FROM n
    UNION ALL SELECT 'description', 'unexpected', 1.0""",
)
def p10(spark, d):
    df = _dirty(spark, d).select("amount", "account_id", "description")
    spec = {
        "amount": {"required": True, "type": "double", "min": -100, "max": 100},
        "account_id": {"required": True, "pattern": r"^ACC\d{3}$"},
        "currency": {"required": True},
    }
    return p.schema_compliance(df, spec)


def _stats_sql(relation: str, columns: dict[str, str]) -> str:
    parts = []
    for name, expr in columns.items():
        for metric, agg in [
            ("count", f"CAST(count({expr}) AS DOUBLE)"), ("mean", f"avg({expr})"), ("std", f"stddev_samp({expr})"),
            ("min", f"min({expr})"), ("max", f"max({expr})"), ("median", f"median({expr})"),
        ]:
            parts.append(f"SELECT '{name}' AS \"column\", '{metric}' AS metric, round({agg}, 4) AS value FROM {relation}")
    return " UNION ALL ".join(parts)


@query(
    "p11_basic_statistics",
    _stats_sql("lineitem", {"l_extendedprice": "l_extendedprice", "l_quantity": "CAST(l_quantity AS DOUBLE)", "l_discount": "l_discount"}),
)
def p11(spark, d):
    li = table(spark, d, "lineitem")
    found = p.basic_statistics(li, ["l_extendedprice", "l_quantity", "l_discount"])
    return found.withColumn("value", F.round("value", 4))


@query(
    "p11_time_statistics",
    f"""WITH {TXN} SELECT epoch_us(min("timestamp")) AS first_time, epoch_us(max("timestamp")) AS last_time,
    CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000) AS BIGINT) AS span_days,
    count(DISTINCT CAST("timestamp" AS DATE)) AS distinct_days FROM txn""",
)
def p11b(spark, d):
    return p.time_statistics(events_txn(spark, d), "timestamp").withColumns(
        {"first_time": micros("first_time"), "last_time": micros("last_time")}
    )


@query(
    "p12_histogram",
    f"""WITH {TXN}, e AS (SELECT min(amount) AS lo, max(amount) AS hi FROM txn),
    b AS (SELECT CAST(least(floor((amount - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin FROM txn, e),
    c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), r AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
    SELECT r.bin AS bin, round(lo + r.bin * (hi - lo) / 10, 6) AS "lower", round(lo + (r.bin + 1) * (hi - lo) / 10, 6) AS "upper",
    coalesce(n, 0) AS count FROM r LEFT JOIN c USING (bin), e""",
)
def p12(spark, d):
    return p.histogram(events_txn(spark, d), "amount").withColumns(
        {"lower": r6("lower"), "upper": r6("upper")}
    )


@query(
    "p12_distribution",
    f"""WITH {TXN}, s AS (SELECT skewness(amount) AS skewness, kurtosis(amount) AS kurtosis, quantile_cont(amount, 0.01) AS p1,
      quantile_cont(amount, 0.05) AS p5, quantile_cont(amount, 0.25) AS p25, quantile_cont(amount, 0.5) AS p50,
      quantile_cont(amount, 0.75) AS p75, quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99 FROM txn)
    SELECT 'amount' AS "column", metric, round(value, 6) AS value FROM (UNPIVOT s ON * INTO NAME metric VALUE value)""",
)
def p12b(spark, d):
    return p.distribution(events_txn(spark, d), "amount").withColumn("value", r6("value"))


_CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "p13_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS correlation FROM lineitem"
        for a in _CORR_COLUMNS
        for b in _CORR_COLUMNS
    ),
)
def p13(spark, d):
    return p.correlation_matrix(table(spark, d, "lineitem"), _CORR_COLUMNS).withColumn(
        "correlation", r6("correlation")
    )


@query(
    "p14_temporal_patterns",
    f"""WITH {TXN} SELECT 'hour' AS unit, CAST(hour("timestamp") AS INTEGER) AS slot, count(*) AS count FROM txn GROUP BY ALL
    UNION ALL SELECT 'weekday', CAST(isodow("timestamp") - 1 AS INTEGER), count(*) FROM txn GROUP BY ALL
    UNION ALL SELECT 'week', CAST(week("timestamp") AS INTEGER), count(*) FROM txn GROUP BY ALL
    UNION ALL SELECT 'month', CAST(month("timestamp") AS INTEGER), count(*) FROM txn GROUP BY ALL""",
)
def p14(spark, d):
    return p.temporal_patterns(events_txn(spark, d), "timestamp")


@query(
    "p15_categorical",
    f"""WITH {TXN} SELECT category AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM txn), 6) AS percent
    FROM txn GROUP BY category""",
)
def p15(spark, d):
    return p.categorical_distribution(events_txn(spark, d), "category").withColumn(
        "percent", r6("percent")
    )


@query(
    "p15_distinct_values",
    f"""WITH {TXN} SELECT 'category' AS "column", 'distinct' AS metric, CAST(count(DISTINCT category) AS DOUBLE) AS value FROM txn
    UNION ALL SELECT 'account_id', 'distinct', CAST(count(DISTINCT account_id) AS DOUBLE) FROM txn""",
)
def p15b(spark, d):
    return p.distinct_values(events_txn(spark, d), ["category", "account_id"])


@query(
    "p16_compare",
    f"""WITH {TXN}, {FEATS}, l AS ({_stats_sql("(SELECT * FROM ft WHERE NOT is_weekend)", {"amount": "amount"}).replace(", 4)", ", 12)")}),
    r AS ({_stats_sql("(SELECT * FROM ft WHERE is_weekend)", {"amount": "amount"}).replace(", 4)", ", 12)")})
    SELECT "column", metric, round(l.value, 6) AS left_value, round(r.value, 6) AS right_value,
      round(r.value - l.value, 6) AS difference FROM l FULL JOIN r USING ("column", metric)""",
)
def p16(spark, d):
    df = t.add_time_features(events_txn(spark, d))
    weekday, weekend = df.filter(~F.col("is_weekend")), df.filter("is_weekend")
    return p.compare_statistics(weekday, weekend, ["amount"]).withColumns(
        {c: r6(c) for c in ("left_value", "right_value", "difference")}
    )


@query(
    "p16_schema_differences",
    f"""WITH {TXN}, {FEATS}, n AS (SELECT count(*) AS n, count(raw_data) AS raw, count(amount) AS amount FROM ft)
    SELECT unnest(['hour', 'day_of_week', 'is_weekend', 'is_business_hours', 'year', 'month', 'day']) AS "column",
      'added' AS change, false AS breaking, n AS filled FROM n
    UNION ALL SELECT 'raw_data', 'removed', true, raw FROM n UNION ALL SELECT 'amount', 'type', true, amount FROM n""",
)
def p16_schema(spark, d):
    df = events_txn(spark, d)
    new = t.add_time_features(df).drop("raw_data").withColumn("amount", F.col("amount").cast("string"))
    return p.schema_differences(df, new, ["raw_data"])
