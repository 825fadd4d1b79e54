"""Queries for sources, sinks and the ingest transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddledger.catalog.common import FEATS, TXN, events_txn, joined, micros, r6, table
from oddledger.operators import transform as t
from oddledger.operators.detectors import get
from oddledger.plans.strategy import DEFAULT_STRATEGY, run_strategy
from oddledger.session import scratch
from oddledger.sources import landing, readers, tables

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _tagged_events(spark, d):
    return table(spark, d, "events").select(
        F.lit("events").alias("_source_file"),
        (F.col("event_id") + 1).alias("_row_number"),
        "event_id",
        F.col("user_id").alias("account_id"),
        F.col("value").alias("amount"),
    )


def _text_events(spark, d):
    return events_txn(spark, d).select(
        "id",
        "account_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("amount").cast("string").alias("amount"),
        "category",
    )


_FILE_SQL = f"""WITH {TXN} SELECT id, account_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
  CAST(amount AS VARCHAR) AS amount, category FROM txn"""
_FILE_COLUMNS = ["id", "account_id", "timestamp", "amount", "category"]


@query("s01_read_csv", _FILE_SQL)
def s01(spark, d):
    path = scratch(spark, "csv")
    _text_events(spark, d).write.csv(path, header=True)
    return readers.read_csv(spark, path).select(*_FILE_COLUMNS)


@query(
    "s01_mixed_headers",
    f"""WITH {TXN} SELECT id, account_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
      CAST(amount AS VARCHAR) AS amount, category || chr(10) || '"two", lines' AS category FROM txn""",
)
def s01_mixed(spark, d):
    """Files with their columns in different orders; quoted values hold quotes and line breaks."""
    path = scratch(spark, "csv")
    rows = _text_events(spark, d).withColumn("category", F.concat("category", F.lit('\n"two", lines')))
    odd = F.col("id").cast("long") % 2 == 1
    rows.filter(~odd).write.csv(f"{path}/a", header=True, escape='"')
    other = ["amount", "category", "id", "timestamp", "account_id"]
    rows.filter(odd).select(*other).write.csv(f"{path}/b", header=True, escape='"', quoteAll=True)
    return readers.read_csv(spark, f"{path}/*").select(*_FILE_COLUMNS)


_JSON_LINES_SQL = f"""{TXN}, l AS (SELECT id, CAST(id AS BIGINT) % 8 AS part, CAST(id AS BIGINT) % 97 = 0 AS broken,
      '{{"id": "' || id || '", "account_id": "' || account_id || '"}}' AS line FROM txn),
    t AS (SELECT id, part, broken, CASE WHEN broken THEN left(line, length(line) - 4) ELSE line END AS line FROM l)"""


def _json_lines(spark, d, path: str) -> None:
    """Eight files with an object on each line; some lines are cut off."""
    number = F.col("id").cast("long")
    line = F.concat(
        F.lit('{"id": "'), "id", F.lit('", "account_id": "'), "account_id", F.lit('"}')
    )
    line = F.when(number % 97 == 0, F.left(line, F.length(line) - 4)).otherwise(line)
    rows = events_txn(spark, d).select((number % 8).alias("part"), line.alias("value"))
    rows.repartition(8, "part").write.partitionBy("part").text(path)


@query(
    "s02_rejects",
    f"""WITH {_JSON_LINES_SQL} SELECT CASE WHEN broken THEN NULL ELSE id END AS id, CASE WHEN broken THEN line END AS text FROM t""",
)
def s02_rejects(spark, d):
    """Good lines are records, cut lines are rejects."""
    path = scratch(spark, "json")
    _json_lines(spark, d, path)
    rows, rejects = readers.read_json_parts(spark, f"{path}/*")
    none = F.lit(None).cast("string")
    return rows.select("id", none.alias("text")).unionByName(rejects.select(none.alias("id"), "text"))


@query("s02_read_json", _FILE_SQL)
def s02(spark, d):
    path = scratch(spark, "json")
    thousand = F.floor(F.col("id").cast("long") / 1000).alias("part")
    batch = F.to_json(F.struct(F.collect_list(F.struct(*_FILE_COLUMNS)).alias("transactions")))
    (
        _text_events(spark, d)
        .groupBy(thousand)
        .agg(batch.alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return readers.read_json(spark, path).select(*_FILE_COLUMNS)


@query("s03_read_xml", _FILE_SQL)
def s03(spark, d):
    path = scratch(spark, "xml")
    rows = _text_events(spark, d)
    rows.write.format("xml").options(rowTag="transaction", rootTag="transactions").save(path)
    return readers.read_xml(spark, path).select(*_FILE_COLUMNS)


@query(
    "s04_known_files",
    f"""WITH {TXN}, l AS (SELECT CAST(id AS BIGINT) % 8 AS part, '{{"id":"' || id || '","account_id":"' || account_id || '"}}' AS line FROM txn),
      f AS (SELECT part, CAST(sum(length(line) + 1) AS BIGINT) AS size FROM l GROUP BY 1)
      SELECT 'json' AS type, size, CAST(0 AS BIGINT) AS rejected, CASE WHEN size > 4500 THEN 'file.size' ELSE '' END AS error,
        size <= 4500 AS valid FROM f""",
)
def s04_known(spark, d):
    """Eight files whose sizes follow from the table."""
    path = scratch(spark, "landing")
    rows = events_txn(spark, d).select((F.col("id").cast("long") % 8).alias("part"), "id", "account_id")
    rows.repartition(8, "part").write.partitionBy("part").json(path)
    found = landing.audit_landing(spark, path, max_bytes=4500).filter(~F.col("file").startswith("_"))
    error = F.regexp_replace(joined("errors"), ":.*", "")
    return found.select("type", "size", "rejected", error.alias("error"), "valid")


@query("s04_audit_landing")
def s04(spark, d):
    path = scratch(spark, "landing")
    _text_events(spark, d).write.csv(f"{path}/csv", header=True)
    _text_events(spark, d).write.json(f"{path}/json")
    found = landing.audit_landing(spark, path, max_bytes=10_000_000)
    return found.filter(~F.col("file").startswith("_")).select(
        "type", "size", joined("errors").alias("errors"), joined("warnings").alias("warnings"), "valid"
    )


@query(
    "s05_required_by_file",
    f"""WITH {TXN}, p AS (SELECT DISTINCT CAST(id AS BIGINT) % 4 AS part FROM txn)
      SELECT CASE part WHEN 0 THEN 'amount' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'account_id' ELSE '' END AS missing,
        part = 3 AS valid FROM p""",
)
def s05_by_file(spark, d):
    """One required column is absent from three of four kinds of files."""
    path, rows = scratch(spark, "csv"), _text_events(spark, d)
    for part, gone in enumerate(["amount", "timestamp", "account_id", None]):
        own = rows.filter(F.col("id").cast("long") % 4 == part)
        own.select(*[F.col(c).alias(c.upper()) for c in _FILE_COLUMNS if c != gone]).write.csv(
            f"{path}/{part}", header=True
        )
    found = readers.required_by_file(spark, f"{path}/*")
    # a job writes as many files of a kind as it has tasks
    return found.select(joined("missing").alias("missing"), "valid").distinct()


@query(
    "s05_required_columns",
    "SELECT true AS complete, 'amount,timestamp' AS missing_elsewhere, count(*) AS checked FROM events",
)
def s05(spark, d):
    df = events_txn(spark, d)
    here = readers.check_required_columns(df, "csv")
    there = readers.check_required_columns(df.select("id", "account_id"), "csv")
    return df.agg(F.count(F.lit(1)).alias("checked")).select(
        F.lit(here["valid"]).alias("complete"),
        F.lit(",".join(there["missing_columns"])).alias("missing_elsewhere"),
        "checked",
    )


def _with_upload(df):
    return df.withColumn("upload_id", F.date_format("timestamp", "yyyy-MM-dd"))


@query(
    "s06_load_transactions",
    f"""WITH {TXN}, {FEATS} SELECT id, account_id, amount, '2024-01-06' AS upload_id, hour, day_of_week, is_weekend
    FROM ft WHERE CAST("timestamp" AS DATE) = DATE '2024-01-06'""",
)
def s06(spark, d):
    path = scratch(spark, "txn")
    tables.write_transactions(_with_upload(t.add_time_features(events_txn(spark, d))), path)
    found = tables.load_transactions(spark, path, "2024-01-06")
    return found.select(
        "id", "account_id", "amount", "upload_id",
        "hour", "day_of_week", "is_weekend",
    )


@query(
    "s07_write_transactions",
    f"""WITH {TXN} SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS upload_id, count(*) AS n,
    round(sum(abs(amount)), 6) AS total_abs, count(*) FILTER (amount > 100) AS n_small FROM txn GROUP BY 1""",
)
def s07(spark, d):
    path = scratch(spark, "txn")
    df = t.add_amount_category(t.add_amount_features(events_txn(spark, d)))
    tables.write_transactions(_with_upload(df), path)
    return (
        tables.load_transactions(spark, path)
        .groupBy("upload_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            r6(F.sum("amount_abs")).alias("total_abs"),
            F.count_if(F.col("amount_category") == "small").alias("n_small"),
        )
    )


_Z = f"""WITH {TXN}, w AS (
  SELECT id, amount, count(*) OVER a AS n, avg(amount) OVER a AS gm, stddev_samp(amount) OVER a AS gs,
         avg(amount) OVER r AS rm, stddev_samp(amount) OVER r AS rs
  FROM txn WINDOW a AS (PARTITION BY account_id),
    r AS (PARTITION BY account_id ORDER BY "timestamp", id ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT id, abs(CASE WHEN n >= 30 THEN CASE WHEN rs > 0 THEN (amount - rm) / rs ELSE 0 END
         WHEN gs > 0 THEN (amount - gm) / gs ELSE 0 END) AS score FROM w WHERE n >= 5)"""


@query(
    "s08_write_scores",
    f"""{_Z} SELECT 'run-1' AS run_id, 'zscore' AS algorithm_name, count(*) AS n, round(sum(score), 2) AS total,
    round(sum(least(1, score / 3)), 1) AS sure FROM z""",
)
def s08(spark, d):
    path = scratch(spark, "scores")
    tables.write_scores(run_strategy(events_txn(spark, d), DEFAULT_STRATEGY), path, "run-1")
    return (
        tables.read_run(spark, path, "run-1")
        .groupBy("run_id", "algorithm_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("score").cast("double"), 2).alias("total"),
            F.round(F.sum("confidence").cast("double"), 1).alias("sure"),
        )
    )


@query(
    "s09_rule_flags",
    f"""WITH {TXN}, {FEATS}, b AS (SELECT quantile_cont(amount, 0.75) AS t FROM ft WHERE NOT is_weekend),
    v AS (SELECT id, is_weekend AND amount > t * 0.3 AS r0, is_weekend AND amount > t AS r1,
      is_weekend AND (hour < 6 OR hour > 22) AS r2 FROM ft, b)
    SELECT id AS transaction_id, 'amount_threshold' AS rule_name, r0 AS triggered FROM v
    UNION ALL SELECT id, 'weekday_threshold', r1 FROM v
    UNION ALL SELECT id, 'unusual_weekend_hour', r2 FROM v""",
)
def s09(spark, d):
    path = scratch(spark, "flags")
    found = get("rule_based", "weekend_threshold").run(
        events_txn(spark, d), {"account_specific": False}
    )
    tables.write_rule_flags(found, path, "run-1")
    return tables.read_run(spark, path, "run-1").select("transaction_id", "rule_name", "triggered")


@query(
    "t01_ensure_ids",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256(concat_ws('|', 'events', event_id + 1, event_id,
    user_id, value)) ELSE CAST(event_id AS VARCHAR) END AS id FROM events""",
)
def t01(spark, d):
    given = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    return t.ensure_ids(_tagged_events(spark, d).withColumn("id", given)).select("event_id", "id")


@query(
    "t02_dedupe_ids",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id // 2 AS VARCHAR)
    ELSE sha256(concat_ws('|', event_id // 2, 'events', event_id + 1)) END AS id FROM events""",
)
def t02(spark, d):
    half = F.floor(F.col("event_id") / 2).cast("string")
    return t.dedupe_ids(_tagged_events(spark, d).withColumn("id", half)).select("event_id", "id")


@query(
    "t03_standardize_columns",
    """SELECT event_id, CAST(value AS VARCHAR) AS amount, CAST(user_id AS VARCHAR) AS account_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", event_type AS external_transaction_id FROM events""",
)
def t03(spark, d):
    e = table(spark, d, "events")
    value, user = F.col("value").cast("string"), F.col("user_id").cast("string")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 3
    mixed = e.select(
        "event_id",
        F.when(kind == 0, value).alias("amount"),
        F.when(kind == 1, value).alias("Belopp"),
        F.when(kind == 2, value).alias("value"),
        F.when(kind == 0, at).alias("timestamp"),
        F.when(kind == 1, at).alias("datum"),
        F.when(kind == 2, at).alias("DATE"),
        F.when(kind == 0, user).alias("account_id"),
        F.when(kind == 1, user).alias("konto"),
        F.when(kind == 2, user).alias("account"),
        F.col("event_type").alias("referens"),
    )
    return t.standardize_columns(mixed).select(
        "event_id", "amount", "account_id", "timestamp", "external_transaction_id"
    )


def _holes(spark, d):
    key = F.col("id").cast("long")
    return events_txn(spark, d).withColumns(
        {
            "amount": F.when(key % 5 != 0, F.col("amount")),
            "account_id": F.when(key % 7 != 0, F.col("account_id")),
            "timestamp": F.when(key % 11 != 0, F.col("timestamp")),
        }
    )


_KEPT = """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS account_id, value AS amount FROM events
    WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0"""


@query("t04_require_fields", _KEPT)
def t04(spark, d):
    return t.require_fields(_holes(spark, d)).select("id", "account_id", "amount")


_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm",
]


def _mixed_times(spark, d):
    key = F.col("id").cast("long") % 7
    at = F.lit("not a date")
    for i, f in enumerate(_FORMATS):
        at = F.when(key == i, F.date_format("timestamp", f)).otherwise(at)
    month_first = F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss")
    return events_txn(spark, d).withColumn("timestamp", F.when(key == 5, month_first).otherwise(at))


@query(
    "t05_standardize_timestamps",
    """WITH x AS (SELECT event_id, CASE event_id % 7
      WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d')
      WHEN 4 THEN strftime(ts, '%d/%m/%Y %H:%M') WHEN 5 THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
      ELSE 'not a date' END AS s FROM events),
    p AS (SELECT event_id, try_strptime(s, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d/%m/%Y %H:%M:%S',
      '%m/%d/%Y %H:%M:%S', '%d/%m/%Y %H:%M']) AS t FROM x)
    SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(t) AS micros FROM p WHERE t IS NOT NULL""",
)
def t05(spark, d):
    return t.standardize_timestamps(_mixed_times(spark, d)).select(
        "id", micros("timestamp").alias("micros")
    )


@query(
    "t05_more_forms",
    """WITH x AS (SELECT event_id, CASE event_id % 6
      WHEN 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y%m%d')
      WHEN 2 THEN strftime(ts, '%d.%m.%Y') WHEN 3 THEN strftime(ts, '%d-%m-%Y %H:%M:%S')
      WHEN 4 THEN strftime(ts, '%b %-d, %Y') ELSE strftime(ts, '%d. %B %Y') END AS s FROM events)
    SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(try_strptime(s, ['%Y/%m/%d %H:%M:%S', '%Y%m%d', '%d.%m.%Y',
      '%d-%m-%Y %H:%M:%S', '%b %d, %Y', '%d. %B %Y'])) AS micros FROM x""",
)
def t05b(spark, d):
    forms = [
        "yyyy/MM/dd HH:mm:ss", "yyyyMMdd", "dd.MM.yyyy", "dd-MM-yyyy HH:mm:ss", "MMM d, yyyy", "dd. MMMM yyyy",
    ]
    key = F.col("id").cast("long") % 6
    text = F.coalesce(*[F.when(key == i, F.date_format("timestamp", f)) for i, f in enumerate(forms)])
    found = t.standardize_timestamps(events_txn(spark, d).withColumn("timestamp", text))
    return found.select("id", micros("timestamp").alias("micros"))


def _mixed_amounts(spark, d):
    """Signed amounts in plain, currency, thousands and European form, and junk."""
    key = F.col("id").cast("long") % 5
    n = F.round((F.col("amount") - 50) * 100, 2)
    text = F.format_number(n, 2)
    swapped = F.translate(text, ",.", ".,")
    return events_txn(spark, d).withColumn(
        "amount",
        F.when(key == 0, F.regexp_replace(text, ",", ""))
        .when(key == 1, F.concat(F.lit("€ "), text))
        .when(key == 2, F.concat(F.lit("$"), text))
        .when(key == 3, swapped)
        .otherwise("invalid"),
    )


@query(
    "t06_clean_amounts",
    """SELECT CAST(event_id AS VARCHAR) AS id, round(round((value - 50) * 100, 2), 2) AS amount
    FROM events WHERE event_id % 5 <> 4""",
)
def t06(spark, d):
    return t.clean_amounts(_mixed_amounts(spark, d)).select("id", F.round("amount", 2).alias("amount"))


@query(
    "t07_standardize_accounts",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'ACC' || user_id AS account_id FROM events
    WHERE event_id % 6 IN (0, 1)""",
)
def t07(spark, d):
    key = F.col("id").cast("long") % 6
    name = F.concat(F.lit("acc"), F.col("account_id"))
    dirty = (
        F.when(key == 0, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(key == 1, F.upper(name))
        .when(key == 2, " ")
        .when(key == 3, "nan")
        .when(key == 4, "None ")
        .otherwise("NULL")
    )
    df = events_txn(spark, d).withColumn("account_id", dirty)
    return t.standardize_accounts(df).select("id", "account_id")


@query(
    "t08_time_features",
    f"""WITH {TXN}, {FEATS} SELECT id, CAST(year("timestamp") AS INTEGER) AS year, CAST(month("timestamp") AS INTEGER) AS month,
    CAST(day("timestamp") AS INTEGER) AS day, hour, day_of_week, is_weekend, is_business_hours FROM ft""",
)
def t08(spark, d):
    return t.add_time_features(events_txn(spark, d)).select(
        "id", "year", "month", "day", "hour", "day_of_week", "is_weekend", "is_business_hours"
    )


def _signed(spark, d):
    return events_txn(spark, d).withColumn("amount", F.col("amount") - 50)


@query(
    "t09_amount_features",
    """SELECT CAST(event_id AS VARCHAR) AS id, round(abs(value - 50), 6) AS amount_abs, value - 50 < 0 AS is_debit,
    value - 50 > 0 AS is_credit FROM events""",
)
def t09(spark, d):
    return t.add_amount_features(_signed(spark, d)).select(
        "id", r6("amount_abs").alias("amount_abs"), "is_debit", "is_credit"
    )


@query(
    "t10_amount_category",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN a <= 100 THEN 'micro' WHEN a <= 1000 THEN 'small'
    WHEN a <= 10000 THEN 'medium' WHEN a <= 100000 THEN 'large' ELSE 'huge' END AS amount_category
    FROM (SELECT o_orderkey, abs(o_totalprice / power(10, o_orderkey % 5)) AS a FROM orders)""",
)
def t10(spark, d):
    o = table(spark, d, "orders")
    scaled = F.col("o_totalprice") / F.pow(F.lit(10.0), F.col("o_orderkey") % 5)
    df = o.select(F.col("o_orderkey").cast("string").alias("id"), scaled.alias("amount"))
    return t.add_amount_category(df).select("id", "amount_category")


@query(
    "t11_sequence",
    f"""WITH {TXN} SELECT id, row_number() OVER (PARTITION BY account_id ORDER BY "timestamp", id)
    AS transaction_sequence FROM txn""",
)
def t11(spark, d):
    return t.add_sequence(events_txn(spark, d)).select("id", "transaction_sequence")


@query(
    "t12_time_since_prev",
    f"""WITH {TXN}, g AS (SELECT id, epoch_us("timestamp") AS t, lag(epoch_us("timestamp")) OVER (
      PARTITION BY account_id ORDER BY "timestamp", id) AS p FROM txn)
    SELECT id, round((t - p) / 3600000000.0, 6) AS time_since_prev FROM g""",
)
def t12(spark, d):
    return t.add_time_since_prev(events_txn(spark, d)).select(
        "id", r6("time_since_prev").alias("time_since_prev")
    )


@query(
    "t13_metadata",
    """SELECT event_id, 'upload-1' AS upload_id, 'events' AS source_file, CAST(event_id + 1 AS VARCHAR) AS row_number,
    CAST(value AS VARCHAR) AS original_amount FROM events""",
)
def t13(spark, d):
    df = t.add_metadata(_tagged_events(spark, d), "upload-1")
    pick = lambda path: F.get_json_object("raw_data", path)
    return df.select(
        "event_id",
        "upload_id",
        pick("$.source_file").alias("source_file"),
        pick("$.row_number").alias("row_number"),
        pick("$.original_data.amount").alias("original_amount"),
    )


@query(
    "t14_final_validation",
    f"""WITH {TXN} SELECT id, epoch_us("timestamp") AS micros, amount FROM txn""",
)
def t14(spark, d):
    return t.final_validation(events_txn(spark, d)).select(
        "id", micros("timestamp").alias("micros"), "amount"
    )


@query(
    "t15_transformation_stats",
    f"""WITH raw AS (SELECT count(*) AS n FROM events), kept AS (SELECT * FROM events
      WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0)
    SELECT min(n) AS original_count, count(*) AS final_count, min(n) - count(*) AS dropped_count,
      round((min(n) - count(*)) / min(n), 6) AS drop_rate, epoch_us(min(ts)) AS date_start,
      epoch_us(max(ts)) AS date_end, min(value) AS amount_min, max(value) AS amount_max,
      round(avg(value), 6) AS amount_mean, round(sum(value), 4) AS amount_total,
      count(DISTINCT user_id) AS unique_accounts, 'amount_abs; is_debit; is_credit' AS features_added
    FROM kept, raw""",
)
def t15(spark, d):
    raw = _holes(spark, d)
    final = t.add_amount_features(t.require_fields(raw))
    return t.transformation_stats(raw, final).select(
        "original_count",
        "final_count",
        "dropped_count",
        r6("drop_rate").alias("drop_rate"),
        micros("date_start").alias("date_start"),
        micros("date_end").alias("date_end"),
        "amount_min",
        "amount_max",
        r6("amount_mean").alias("amount_mean"),
        F.round("amount_total", 4).alias("amount_total"),
        "unique_accounts",
        joined("features_added").alias("features_added"),
    )


@query("t16_prepare", _KEPT)
def t16(spark, d):
    return t.prepare(_holes(spark, d), min_rows=20).select("id", "account_id", "amount")


@query(
    "t17_transform_chain",
    """WITH x AS (SELECT event_id, user_id, ts, round(round((value - 50) * 100, 2), 2) AS amount
      FROM events WHERE event_id % 5 <> 4)
    SELECT CAST(event_id AS VARCHAR) AS id, 'ACC' || user_id AS account_id, amount, epoch_us(ts) AS micros,
      CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) >= 6 AS is_weekend,
      CASE WHEN abs(amount) <= 100 THEN 'micro' WHEN abs(amount) <= 1000 THEN 'small'
        WHEN abs(amount) <= 10000 THEN 'medium' WHEN abs(amount) <= 100000 THEN 'large' ELSE 'huge' END AS amount_category,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS transaction_sequence
    FROM x""",
)
def t17(spark, d):
    raw = _mixed_amounts(spark, d).select(
        F.lit("events").alias("_source_file"),
        F.col("id").cast("long").alias("_row_number"),
        "id",
        F.concat(F.lit(" acc"), F.col("account_id")).alias("konto"),
        F.col("amount").alias("belopp"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datum"),
    )
    return t.transform(raw).select(
        "id",
        "account_id",
        F.round("amount", 2).alias("amount"),
        micros("timestamp").alias("micros"),
        "hour",
        "is_weekend",
        "amount_category",
        "transaction_sequence",
    )
