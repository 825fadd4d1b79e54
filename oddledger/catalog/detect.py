"""Queries for the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddledger.catalog.common import FEATS, ORDERS, TXN, events_txn, joined, micros, orders_txn, r6
from oddledger.operators import detectors as det
from oddledger.operators.detectors import Transactions, timeseries, weekend
from oddledger.operators.transform import add_time_features
from oddledger.session import durable

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def result(df, *metadata: str):
    """Detector result in comparable form."""
    kinds = dict(df.select("metadata.*").dtypes)
    extra = [
        (r6(f"metadata.{m}") if kinds[m] == "double" else F.col(f"metadata.{m}")).alias(m)
        for m in metadata
    ]
    return df.select(
        "transaction_id", r6("score").alias("score"), r6("confidence").alias("confidence"), *extra
    )


# -- z-score -------------------------------------------------------------------


def zscore_sql(view: str = TXN, threshold: float = 3.0, window: int = 30, name: str = "zs") -> str:
    """CTEs up to ``zs(id, score, confidence, mean_amount)`` for the account z-score."""
    return f"""{view}, {name}_w AS (
  SELECT id, amount, count(*) OVER a AS n, avg(amount) OVER a AS gm, stddev_samp(amount) OVER a AS gs,
         avg(amount) OVER r AS rm, stddev_samp(amount) OVER r AS rs
  FROM txn WINDOW a AS (PARTITION BY account_id),
    r AS (PARTITION BY account_id ORDER BY "timestamp", id ROWS BETWEEN {window - 1} PRECEDING AND 1 PRECEDING)),
 {name}_z AS (SELECT id, CASE WHEN n >= {window} THEN rm ELSE gm END AS mean_amount,
    CASE WHEN n >= {window} THEN CASE WHEN rs > 0 THEN (amount - rm) / rs ELSE 0 END
         WHEN gs > 0 THEN (amount - gm) / gs ELSE 0 END AS z FROM {name}_w WHERE n >= 5),
 {name} AS (SELECT id, abs(z) AS score, least(1, abs(z) / {threshold}) AS confidence, mean_amount, z FROM {name}_z)"""


_Z_OUT = """SELECT id AS transaction_id, round(score, 6) AS score, round(confidence, 6) AS confidence,
  round(mean_amount, 6) AS mean_amount FROM zs"""
ZSCORE = ("statistical", "zscore")


@query("d1a_zscore_rolling", f"WITH {zscore_sql()} {_Z_OUT}")
def d1a(spark, d):
    return result(det.get(*ZSCORE).run(events_txn(spark, d)), "mean_amount")


@query("d1b_zscore_whole", f"WITH {zscore_sql(ORDERS)} {_Z_OUT}")
def d1b(spark, d):
    return result(det.get(*ZSCORE).run(orders_txn(spark, d)), "mean_amount")


@query(
    "d1b_zscore_signed",
    f"""WITH {TXN}, w AS (SELECT id, amount, count(*) OVER a AS n, avg(amount) OVER a AS m, stddev_samp(amount) OVER a AS s
      FROM txn WINDOW a AS (PARTITION BY account_id))
    SELECT id AS transaction_id, round((amount - m) / s, 6) AS score, round(least(1, abs((amount - m) / s) / 2), 6) AS confidence,
      n AS total_transactions FROM w WHERE n >= 60""",
)
def d1b_signed(spark, d):
    config = {
        "use_rolling_window": False, "absolute_zscore": False, "threshold": 2, "min_transactions": 60
    }
    return result(det.get(*ZSCORE).run(events_txn(spark, d), config), "total_transactions")


_GLOBAL_ROLL = """w AS (SELECT id, amount, avg(amount) OVER r AS m, stddev_samp(amount) OVER r AS s
      FROM txn WINDOW r AS (ORDER BY "timestamp", id ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT id, m, CASE WHEN s > 0 THEN abs((amount - m) / s) ELSE 0 END AS z FROM w)
    SELECT id AS transaction_id, round(z, 6) AS score, round(least(1, z / 3), 6) AS confidence, round(m, 6) AS mean_amount FROM z"""


@query("d1c_zscore_global_rolling", f"WITH {TXN}, {_GLOBAL_ROLL}")
def d1c(spark, d):
    config = {"account_specific": False, "window_size": 50}
    return result(det.get(*ZSCORE).run(events_txn(spark, d), config), "mean_amount")


@query("d1c_zscore_global_ties", f"WITH {ORDERS}, {_GLOBAL_ROLL}")
def d1c_ties(spark, d):
    config = {"account_specific": False, "window_size": 50}
    return result(det.get(*ZSCORE).run(orders_txn(spark, d), config), "mean_amount")


@query(
    "d1d_zscore_global",
    f"""WITH {TXN}, s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM txn)
    SELECT id AS transaction_id, round(abs((amount - m) / s), 6) AS score, round(least(1, abs((amount - m) / s) / 3), 6) AS confidence,
      round(s, 6) AS std_amount FROM txn, s""",
)
def d1d(spark, d):
    config = {"account_specific": False, "use_rolling_window": False}
    return result(det.get(*ZSCORE).run(events_txn(spark, d), config), "std_amount")


# -- correlation ---------------------------------------------------------------

_F3 = ["CAST(amount AS DOUBLE)", "CAST(hour AS DOUBLE)", "CAST(day_of_week AS DOUBLE)"]


def _correlation_finish(source: str) -> str:
    """Scores from per-row frame moments m*, s*, c** and correlations r**."""
    pairs = [(0, 1), (0, 2), (1, 2)]
    gaps = ", ".join(
        f"CASE WHEN abs(r{i}{j}) > 0.3 THEN abs(f{j} - (m{j} + c{i}{j} / (s{i} * s{i}) * (f{i} - m{i}))) / (s{j} + 1e-6) END"
        for i, j in pairs
    )
    strengths = ", ".join(f"abs(r{i}{j})" for i, j in pairs)
    return f"""lists AS (SELECT id, n, rows, list_filter([{gaps}], lambda x: x IS NOT NULL) AS g,
      list_filter([{strengths}], lambda x: x IS NOT NULL) AS st FROM {source})
    SELECT id AS transaction_id, round(CASE WHEN n < 50 OR rows < 10 OR len(g) = 0 THEN 0.1
        ELSE greatest(0, least(1, (list_avg(g) + list_max(g)) / 4)) END, 6) AS score,
      round(CASE WHEN n < 50 THEN 0.3 WHEN rows < 10 OR len(g) = 0 THEN 0.2
        ELSE least(1, coalesce(list_avg(st), 0) + 0.3) END, 6) AS confidence FROM lists"""


def _moments(view: str) -> str:
    stats = ", ".join(f"avg(f{i}) OVER w AS m{i}, stddev_pop(f{i}) OVER w AS s{i}" for i in range(3))
    cov = ", ".join(f"covar_pop(f{i}, f{j}) OVER w AS c{i}{j}" for i, j in [(0, 1), (0, 2), (1, 2)])
    return f"""{view}, {FEATS}, x AS (SELECT id, account_id, "timestamp", {", ".join(f"{e} AS f{i}" for i, e in enumerate(_F3))} FROM ft),
    mo AS (SELECT id, f0, f1, f2, count(*) OVER a AS n, count(*) OVER w AS rows, {stats}, {cov} FROM x
      WINDOW a AS (PARTITION BY account_id),
        w AS (PARTITION BY account_id ORDER BY "timestamp", id ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING))"""


_PEARSON = "pe AS (SELECT *, {} FROM mo)".format(
    ", ".join(
        f"CASE WHEN s{i} > 1e-9 * abs(m{i}) AND s{j} > 1e-9 * abs(m{j}) THEN c{i}{j} / (s{i} * s{j}) END AS r{i}{j}"
        for i, j in [(0, 1), (0, 2), (1, 2)]
    )
)
CORRELATION = ("statistical", "correlation")


@query("d2a_correlation_pearson", f"WITH {_moments(TXN)}, {_PEARSON}, {_correlation_finish('pe')}")
def d2a(spark, d):
    return result(det.get(*CORRELATION).run(events_txn(spark, d)))


_TINY = TXN.replace("value AS amount", "value * 1e-12 AS amount")


@query("d2a_correlation_tiny_amounts", f"WITH {_moments(_TINY)}, {_PEARSON}, {_correlation_finish('pe')}")
def d2a_tiny(spark, d):
    """Amounts in another unit: the relation between features is the same."""
    tiny = events_txn(spark, d).withColumn("amount", F.col("amount") * 1e-12)
    return result(det.get(*CORRELATION).run(tiny, None))


@query(
    "d2a_correlation_constant_hour",
    f"""WITH {ORDERS}, c AS (SELECT id, count(*) OVER (PARTITION BY account_id) AS n FROM txn)
    SELECT id AS transaction_id, 0.1 AS score, CASE WHEN n < 5 THEN 0.3 ELSE 0.2 END AS confidence FROM c""",
)
def d2a_constant(spark, d):
    """All orders are at midnight: the only pair has a constant side."""
    config = {"window_size": 10, "features": ["amount", "hour"]}
    return result(det.get(*CORRELATION).run(orders_txn(spark, d), config))


_FRAME = """po AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY "timestamp", id) AS p FROM x),
    fr AS (SELECT a.id AS center, b.f0, b.f1, b.f2, b.p FROM po a JOIN po b
      ON a.account_id = b.account_id AND b.p BETWEEN a.p - 50 AND a.p + 50)"""


def _rank_sql() -> str:
    ranks = ", ".join(
        f"rank() OVER (PARTITION BY center ORDER BY f{i}) + (count(*) OVER (PARTITION BY center, f{i}) - 1) / 2.0 AS k{i}"
        for i in range(3)
    )
    corr = ", ".join(
        f"CASE WHEN stddev_pop(k{i}) > 1e-9 AND stddev_pop(k{j}) > 1e-9 THEN covar_pop(k{i}, k{j}) / (stddev_pop(k{i}) * stddev_pop(k{j})) END AS r{i}{j}"
        for i, j in [(0, 1), (0, 2), (1, 2)]
    )
    return f"""{_FRAME}, ra AS (SELECT center, {ranks} FROM fr), co AS (SELECT center, {corr} FROM ra GROUP BY center),
    pe AS (SELECT mo.*, r01, r02, r12 FROM mo JOIN co ON mo.id = co.center)"""


def _kendall_sql() -> str:
    sums = ", ".join(
        f"sum(sign(b.f{i} - a.f{i}) * sign(b.f{j} - a.f{j})) / nullif(sqrt(sum(abs(sign(b.f{i} - a.f{i}))) * sum(abs(sign(b.f{j} - a.f{j})))), 0) AS r{i}{j}"
        for i, j in [(0, 1), (0, 2), (1, 2)]
    )
    return f"""{_FRAME}, co AS (SELECT a.center, {sums} FROM fr a JOIN fr b ON a.center = b.center AND a.p < b.p GROUP BY a.center),
    pe AS (SELECT mo.*, r01, r02, r12 FROM mo LEFT JOIN co ON mo.id = co.center)"""


@query("d2b_correlation_spearman", f"WITH {_moments(TXN)}, {_rank_sql()}, {_correlation_finish('pe')}")
def d2b(spark, d):
    return result(det.get(*CORRELATION).run(events_txn(spark, d), {"correlation_type": "spearman"}))


@query("d2c_correlation_kendall", f"WITH {_moments(TXN)}, {_kendall_sql()}, {_correlation_finish('pe')}")
def d2c(spark, d):
    return result(det.get(*CORRELATION).run(events_txn(spark, d), {"correlation_type": "kendall"}))


# -- time series ---------------------------------------------------------------

_STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}
_VALUE = {"count": "count(*)", "sum": "sum(amount)", "mean": "avg(amount)"}


def series_sql(unit: str, how: str) -> str:
    return f"""pc AS (SELECT date_trunc('{unit}', "timestamp") AS period, CAST({_VALUE[how]} AS DOUBLE) AS v FROM txn GROUP BY 1),
    cal AS (SELECT unnest(generate_series((SELECT min(CAST(period AS TIMESTAMP)) FROM pc), (SELECT max(CAST(period AS TIMESTAMP)) FROM pc), {_STEP[unit]})) AS period),
    se AS (SELECT cal.period, coalesce(v, 0) AS value, count(*) OVER () AS n FROM cal LEFT JOIN pc ON cal.period = CAST(pc.period AS TIMESTAMP))"""


def adjusted_sql(width: int) -> str:
    """Seasonal adjustment for more than 48 periods."""
    frame = f"(ORDER BY period ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)"
    return f"""dt AS (SELECT period, value, CASE WHEN count(*) OVER {frame} = {width} THEN value - avg(value) OVER {frame} END AS de FROM se),
    pr AS (SELECT hour(period) AS h, avg(de) AS mean_de FROM dt GROUP BY 1),
    ad AS (SELECT period, value, coalesce(de - mean_de, value) AS v FROM dt JOIN pr ON hour(period) = h)"""


def flags_sql(method: str = "std", k: float = 2.0) -> str:
    limits = {
        "std": f"avg(v) + {k} * stddev_samp(v) AS up, greatest(0, avg(v) - {k} * stddev_samp(v)) AS lo",
        "iqr": f"""quantile_cont(v, 0.75) + {k} * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS up,
          greatest(0, quantile_cont(v, 0.25) - {k} * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))) AS lo""",
        "percentile": f"quantile_cont(v, {k / 100}) AS up, quantile_cont(v, {1 - k / 100}) AS lo",
    }[method]
    return f"""li AS (SELECT avg(v) AS mean, min(v) AS low, max(v) AS high, {limits} FROM ad),
    fl AS (SELECT period, v, mean, least(1, 0.5 + 0.5 * CASE WHEN v > up THEN (v - up) / greatest(high - up, 1)
        ELSE (lo - v) / greatest(lo - low, 1) END) AS ps FROM ad, li WHERE v > up OR v < lo)"""


_SERIES_OUT = "SELECT epoch_us(period) AS period, round(value, 6) AS value FROM se"


def _series(unit, how):
    def run(spark, d):
        found = timeseries.period_series(events_txn(spark, d), unit, how)
        return found.select(micros("period").alias("period"), r6("value").alias("value"))

    return run


for _unit, _how in [("hour", "count"), ("day", "sum"), ("week", "mean")]:
    _name = f"d3a_series_{_unit}_{_how}"
    QUERIES[_name] = _series(_unit, _how)
    SQL[_name] = f"WITH {TXN}, {series_sql(_unit, _how)} {_SERIES_OUT}"


@query(
    "d3b_seasonal_adjustment",
    f"""WITH {TXN}, {series_sql("hour", "count")}, {adjusted_sql(24)}
    SELECT epoch_us(period) AS period, round(v, 6) AS adjusted FROM ad""",
)
def d3b(spark, d):
    df = events_txn(spark, d)
    series = timeseries.period_series(df, "hour", "count")
    found = timeseries.seasonal_adjustment(series, series.count())
    return found.select(micros("period").alias("period"), r6("adjusted").alias("adjusted"))


_FLAGS_OUT = """SELECT epoch_us(period) AS period, round(ps, 6) AS period_score, round(0.7 + 0.3 * ps, 6) AS period_confidence,
  round(v, 6) AS period_value, round(abs(v - mean), 6) AS deviation FROM fl"""


def _flagged(method: str, k: float):
    def run(spark, d):
        df = events_txn(spark, d)
        config = {
            "threshold_method": method, "threshold_multiplier": k, "seasonal_adjustment": True
        }
        series = timeseries.period_series(df, "hour", "count")
        found = timeseries.anomalous_periods(series, series.count(), config)
        numbers = ["period_score", "period_confidence", "period_value", "deviation"]
        return found.select(micros("period").alias("period"), *[r6(c).alias(c) for c in numbers])

    return run


for _method, _k in [("std", 2.0), ("iqr", 1.5), ("percentile", 95.0)]:
    _name = f"d3c_periods_{_method}"
    QUERIES[_name] = _flagged(_method, _k)
    SQL[_name] = f"""WITH {TXN}, {series_sql("hour", "count")}, {adjusted_sql(24)}, {flags_sql(_method, _k)} {_FLAGS_OUT}"""


def _rows_sql(unit: str, how: str) -> str:
    share = "ps * (0.5 + 0.5 * abs(amount) / (v + 1e-6))" if how != "count" else "ps"
    return f"""gl AS (SELECT txn.id, txn.account_id, CASE WHEN ps IS NULL THEN 0.1 ELSE least(1, {share}) END AS gs,
      CASE WHEN ps IS NULL THEN 0.8 ELSE 0.7 + 0.3 * ps END AS gc
      FROM txn LEFT JOIN fl ON CAST(date_trunc('{unit}', txn."timestamp") AS TIMESTAMP) = fl.period)"""


@query(
    "d3d_period_scores",
    f"""WITH {TXN}, {series_sql("hour", "sum")}, {adjusted_sql(24)}, {flags_sql()}, {_rows_sql("hour", "sum")}
    SELECT id AS transaction_id, round(gs, 6) AS score, round(gc, 6) AS confidence FROM gl""",
)
def d3d(spark, d):
    txns = Transactions(events_txn(spark, d))
    config = det.get("statistical", "timeseries").merged({"aggregation_method": "sum"})
    found = timeseries.global_scores(txns, txns.df, config)
    return found.select(
        F.col("id").alias("transaction_id"),
        r6("g_score").alias("score"),
        r6("g_confidence").alias("confidence"),
    )


TIMING = """gp AS (SELECT id, account_id, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY account_id
      ORDER BY "timestamp", id)) / 3600000000.0 AS d FROM txn),
    st AS (SELECT account_id, count(*) AS n, median(d) AS md, stddev_samp(d) AS sd FROM gp GROUP BY 1),
    ti AS (SELECT id, CASE WHEN n < 5 OR d IS NULL THEN 0.1 WHEN d < md * 0.1 AND d < 1 THEN 0.8 WHEN d > md * 10 AND d > 168 THEN 0.6
        WHEN sd > 0 AND abs(d - md) / sd > 3 THEN least(0.9, 0.3 + 0.1 * abs(d - md) / sd) ELSE 0.1 END AS s,
      CASE WHEN n < 5 THEN 0.3 WHEN d IS NULL THEN 0.5 WHEN d < md * 0.1 AND d < 1 THEN 0.9 WHEN d > md * 10 AND d > 168 THEN 0.7
        WHEN sd > 0 AND abs(d - md) / sd > 3 THEN 0.8 ELSE 0.6 END AS c,
      CASE WHEN n < 5 THEN 'insufficient_transactions' WHEN d IS NULL THEN 'first_transaction' WHEN d < md * 0.1 AND d < 1 THEN 'rapid_transaction'
        WHEN d > md * 10 AND d > 168 THEN 'delayed_transaction' WHEN sd > 0 AND abs(d - md) / sd > 3 THEN 'unusual_interval' ELSE 'normal' END AS pattern
      FROM gp JOIN st USING (account_id))"""


def _timing(view):
    def run(spark, d):
        txns = Transactions(view(spark, d))
        found = timeseries.account_timing(txns.split())
        return found.select(
            F.col("id").alias("transaction_id"),
            r6("a_score").alias("score"),
            r6("a_confidence").alias("confidence"),
            "timing_pattern",
        )

    return run


_TIMING_OUT = """SELECT id AS transaction_id, round(s, 6) AS score, round(c, 6) AS confidence, pattern AS timing_pattern FROM ti"""
QUERIES["d3e_account_timing"] = _timing(events_txn)
SQL["d3e_account_timing"] = f"WITH {TXN}, {TIMING} {_TIMING_OUT}"
QUERIES["d3e_account_timing_orders"] = _timing(orders_txn)
SQL["d3e_account_timing_orders"] = f"WITH {ORDERS}, {TIMING} {_TIMING_OUT}"

COMBINED = """co AS (SELECT gl.id, greatest(gs, s) AS score, CASE WHEN s > gs THEN greatest(gc, c) ELSE gc END AS confidence,
      CASE WHEN s > gs THEN 'account' ELSE 'global' END AS source FROM gl JOIN ti USING (id))"""
TIMESERIES_SQL = f"""{series_sql("hour", "count")}, {adjusted_sql(24)}, {flags_sql()}, {_rows_sql("hour", "count")}, {TIMING}, {COMBINED}"""


@query(
    "d3f_timeseries",
    f"""WITH {TXN}, {TIMESERIES_SQL} SELECT id AS transaction_id, round(score, 6) AS score, round(confidence, 6) AS confidence, source FROM co""",
)
def d3f(spark, d):
    return result(det.get("statistical", "timeseries").run(events_txn(spark, d)), "source")


# -- weekend -------------------------------------------------------------------


def _baseline(method: str, prefix: str = "") -> str:
    return {
        "percentile": "quantile_cont(abs(amount), 0.75)",
        "mean_std": "avg(abs(amount)) + 2 * stddev_samp(abs(amount))",
        "median_iqr": "median(abs(amount)) + 1.5 * (quantile_cont(abs(amount), 0.75) - quantile_cont(abs(amount), 0.25))",
    }[method]


@query(
    "d4a_weekday_baseline",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS method, count(*) AS count, round({_baseline(m)}, 6) AS amount_threshold, round(avg(amount), 6) AS mean_amount,
      round(stddev_samp(amount), 6) AS std_amount, round(median(amount), 6) AS median_amount, max(amount) AS max_amount, min(amount) AS min_amount,
      round(count(*) / greatest(1, floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000) * 5 / 7), 6) AS frequency_per_day
      FROM (WITH {TXN}, {FEATS} SELECT * FROM ft WHERE NOT is_weekend)"""
        for m in weekend.METHODS
    ),
)
def d4a(spark, d):
    df = add_time_features(events_txn(spark, d))
    rows = df.count()
    out = None
    for m in weekend.METHODS:
        config = det.get("rule_based", "weekend_threshold").merged({"amount_threshold_method": m})
        base = weekend.weekday_baseline(df, config, rows)
        numbers = [c for c in base.columns if c not in ("count", "max_amount", "min_amount")]
        part = base.withColumns({c: r6(c) for c in numbers}).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_sql(name: str, source: str, missing: str, missing_confidence: float, mult: float = 0.3) -> str:
    """Weekend rule over ``source(id, amount, hour, is_weekend, thr, mx, cnt)``."""
    over = f"abs(amount) > thr * {mult}"
    return f"""{name} AS (SELECT id, CASE WHEN {missing} OR NOT is_weekend THEN 0.1 ELSE least(1, 0.1
        + CASE WHEN {over} THEN 0.6 * least(1, (abs(amount) - thr * {mult}) / greatest(mx - thr * {mult}, 1)) ELSE 0 END
        + CASE WHEN abs(amount) > thr THEN 0.3 * least(1, (abs(amount) - thr) / greatest(mx - thr, 1)) ELSE 0 END
        + CASE WHEN hour < 6 OR hour > 22 THEN 0.2 ELSE 0 END) END AS s,
      CASE WHEN {missing} THEN {missing_confidence} WHEN NOT is_weekend THEN 0.8 ELSE
        CASE WHEN (CASE WHEN {over} THEN 1 ELSE 0 END) + (CASE WHEN abs(amount) > thr THEN 1 ELSE 0 END)
          + (CASE WHEN hour < 6 OR hour > 22 THEN 1 ELSE 0 END) > 1 THEN 0.9 ELSE 0.7 END * CASE WHEN cnt < 10 THEN 0.7 ELSE 1 END END AS c,
      CASE WHEN {missing} OR NOT is_weekend THEN '' ELSE concat_ws('; ', CASE WHEN {over} THEN 'amount_threshold' END,
        CASE WHEN abs(amount) > thr THEN 'weekday_threshold' END, CASE WHEN hour < 6 OR hour > 22 THEN 'unusual_weekend_hour' END) END AS v
      FROM {source})"""


_GLOBAL_BASE = """gb AS (SELECT ft.*, thr, mx, cnt FROM ft, (SELECT quantile_cont(abs(amount), 0.75) AS thr, max(abs(amount)) AS mx,
      count(*) AS cnt FROM ft WHERE NOT is_weekend))"""
_ACCOUNT_BASE = """ab AS (SELECT ft.*, thr, mx, coalesce(cnt, 0) AS cnt FROM ft LEFT JOIN (SELECT account_id, quantile_cont(abs(amount), 0.75) AS thr,
      max(abs(amount)) AS mx, count(*) AS cnt FROM ft WHERE NOT is_weekend GROUP BY 1) USING (account_id))"""
WEEKEND = ("rule_based", "weekend_threshold")


@query(
    "d4b_weekend_global",
    f"""WITH {TXN}, {FEATS}, {_GLOBAL_BASE}, {evaluate_sql("ev", "gb", "cnt = 0", 0.2)}
    SELECT id AS transaction_id, round(s, 6) AS score, round(c, 6) AS confidence, v AS violations FROM ev""",
)
def d4b(spark, d):
    found = det.get(*WEEKEND).run(events_txn(spark, d), {"account_specific": False})
    return result(found, "violations").withColumn("violations", joined("violations"))


def weekend_sql(mult: float = 0.3) -> str:
    return f"""{FEATS}, {_GLOBAL_BASE}, {_ACCOUNT_BASE}, {evaluate_sql("eg", "gb", "cnt = 0", 0.2, mult)},
    {evaluate_sql("ea", "ab", "cnt < 3", 0.3, mult)},
    wk AS (SELECT eg.id, greatest(ea.s, eg.s) AS score, greatest(ea.c, eg.c) AS confidence,
      CASE WHEN ea.s > eg.s THEN 'account' ELSE 'global' END AS score_source FROM eg JOIN ea USING (id))"""


WEEKEND_SQL = weekend_sql()
_WEEKEND_OUT = "SELECT id AS transaction_id, round(score, 6) AS score, round(confidence, 6) AS confidence, score_source FROM wk"


@query(
    "d4c_weekend_account",
    f"""WITH {ORDERS}, {FEATS}, {_ACCOUNT_BASE}, {evaluate_sql("ea", "ab", "cnt < 3", 0.3)}
    SELECT id AS transaction_id, round(s, 6) AS score, round(c, 6) AS confidence FROM ea""",
)
def d4c(spark, d):
    detector = det.get(*WEEKEND)
    txns = Transactions(orders_txn(spark, d))
    config = detector.merged({})
    based = weekend.account_baseline(txns.split().map(add_time_features), config)
    s, c, _ = weekend._evaluate(
        config, F.col("_count"), F.col("_q"), F.col("_max"), F.col("_count") < 3, 0.3
    )
    return based.select(
        F.col("id").alias("transaction_id"), r6(s).alias("score"), r6(c).alias("confidence")
    )


@query("d4d_weekend_merged", f"WITH {TXN}, {WEEKEND_SQL} {_WEEKEND_OUT}")
def d4d(spark, d):
    return result(det.get(*WEEKEND).run(events_txn(spark, d)), "score_source")


@query("d4d_weekend_merged_orders", f"WITH {ORDERS}, {WEEKEND_SQL} {_WEEKEND_OUT}")
def d4d_orders(spark, d):
    return result(det.get(*WEEKEND).run(orders_txn(spark, d)), "score_source")


# -- isolation forest: no SQL, checked by properties in the tests -----------------

FOREST = ("ml_based", "isolation_forest")


@query(
    "d5a_features",
    f"""WITH {TXN}, {FEATS} SELECT id, amount, CAST(hour AS DOUBLE) AS hour, CAST(day_of_week AS DOUBLE) AS day_of_week,
      abs(amount) AS amount_abs, round(ln(1 + abs(amount)), 6) AS amount_log FROM ft""",
)
def d5a(spark, d):
    from oddledger.operators.detectors.iforest import feature_columns

    df, names, exprs = feature_columns(events_txn(spark, d), det.get(*FOREST).merged({}))
    return df.select("id", *[e.alias(n) for n, e in exprs.items()]).withColumn(
        "amount_log", r6("amount_log")
    )


@query("d5b_forest_global")
def d5b(spark, d):
    return result(det.get(*FOREST).run(events_txn(spark, d)), "isolation_score", "is_outlier")


@query("d5c_forest_account")
def d5c(spark, d):
    config = {"account_specific": True, "n_estimators": 30}
    return result(det.get(*FOREST).run(events_txn(spark, d), config), "is_outlier")


@query("d5d_forest_scores_in_range")
def d5d(spark, d):
    found = det.get(*FOREST).run(orders_txn(spark, d), {"n_estimators": 50})
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("score").alias("lowest"),
        F.max("score").alias("highest"),
        r6(F.avg(F.col("metadata.is_outlier").cast("double"))).alias("outlier_rate"),
    )


@query("d5e_forest_confidence")
def d5e(spark, d):
    found = det.get(*FOREST).run(orders_txn(spark, d), {"n_estimators": 50})
    return found.groupBy(F.col("metadata.is_outlier").alias("is_outlier")).agg(
        F.min("confidence").alias("lowest"), F.max("confidence").alias("highest")
    )


# the rescaling on a column of the table: what the forest's own decision goes through
_RANGE = "r AS (SELECT min(amount) AS lo, max(amount) AS hi FROM txn)"


@query(
    "d5d_normalise",
    f"""WITH {TXN}, {_RANGE} SELECT id, round(CASE WHEN hi - lo <= 0 THEN 0.1
      ELSE greatest(0.01, least(0.99, (hi - amount) / (hi - lo))) END, 6) AS score FROM txn, r""",
)
def d5d_normalise(spark, d):
    from oddledger.operators.detectors.iforest import normal_score

    df = events_txn(spark, d)
    low, high = (df.agg(f("amount")).scalar() for f in (F.min, F.max))
    return df.select("id", r6(normal_score(F.col("amount"), low, high)).alias("score"))


@query(
    "d5e_confidence",
    f"""WITH {TXN}, {_RANGE}, m AS (SELECT id, amount - (lo + hi) / 2 AS d, (hi - lo) / 2 AS far FROM txn, r)
      SELECT id, round(CASE WHEN d < 0 THEN greatest(0.1, least(0.95, abs(d) / far + 0.3))
        ELSE greatest(0.1, least(0.9, abs(d) / far + 0.1)) END, 6) AS confidence FROM m""",
)
def d5e_confidence(spark, d):
    from oddledger.operators.detectors.iforest import confidence_of

    df = events_txn(spark, d)
    low, high = (df.agg(f("amount")).scalar() for f in (F.min, F.max))
    half = (high - low) / 2
    found = confidence_of(F.col("amount") - (low + high) / 2, -half, half)
    return df.select("id", r6(found).alias("confidence"))


def _facts(found, *more):
    """One row of what holds for scores of any forest."""
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("score").between(0.01, 0.99)).alias("outside"),
        F.count_if(~F.col("confidence").between(0.1, 0.95)).alias("unsure"),
        *more,
    )


def _near():
    """The share of outliers is about the contamination asked for."""
    return F.abs(F.avg(F.col("metadata.is_outlier").cast("double")) - 0.1) < 0.01


@query(
    "d5b_forest_facts",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unsure, true AS share FROM events",
)
def d5b_facts(spark, d):
    """The share of outliers is that asked for, all values lie in their ranges."""
    return _facts(det.get(*FOREST).run(events_txn(spark, d)), _near().alias("share"))


@query(
    "d5b_forest_large_samples",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unsure, true AS share FROM events",
)
def d5b_large(spark, d):
    """Half of all rows in every tree."""
    config = {"max_samples": 0.5, "n_estimators": 5}
    return _facts(det.get(*FOREST).run(events_txn(spark, d), config), _near().alias("share"))


@query(
    "d5c_forest_account_facts",
    f"""WITH {TXN}, c AS (SELECT account_id, count(*) AS k FROM txn GROUP BY 1)
      SELECT CAST(sum(k) AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS unsure,
        CAST(coalesce(sum(k) FILTER (k < 60), 0) AS BIGINT) AS too_few FROM c""",
)
def d5c_facts(spark, d):
    """Rows of accounts with too few rows have the fixed pair of values."""
    config = {"account_specific": True, "n_estimators": 20, "min_samples_fit": 60}
    found = det.get(*FOREST).run(events_txn(spark, d), config)
    few = (F.col("score") == 0.1) & (F.col("confidence") == 0.3) & F.col("metadata.reason").isNotNull()
    return _facts(found, F.count_if(few).alias("too_few"))


@query(
    "d5f_forest_parts",
    """SELECT count(*) AS n, true AS same FROM events WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def d5f_parts(spark, d):
    """Later rows get one score whether the forest is broadcast or rows meet its parts."""
    df = events_txn(spark, d)
    later = df.filter(F.col("timestamp") >= "2024-01-15")
    model = durable(det.get(*FOREST).fit(df.filter(F.col("timestamp") < "2024-01-15"), {"n_estimators": 30}))
    whole = det.get(*FOREST).score(model, later).select("transaction_id", "score")
    parts = det.get(*FOREST).score(model, later, by_parts=True)
    parts = parts.select("transaction_id", F.col("score").alias("other"))
    both = whole.join(parts, "transaction_id", "full_outer")
    far = F.max(F.coalesce(F.abs(F.col("score") - F.col("other")), F.lit(1.0)))
    return both.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(far, F.lit(0.0)) < 1e-9).alias("same"))


@query("d5f_forest_fit_then_score")
def d5f(spark, d):
    from oddledger.session import scratch

    df = events_txn(spark, d)
    early = df.filter(F.col("timestamp") < "2024-01-15")
    path = scratch(spark, "forest")
    det.get(*FOREST).fit(early, {"n_estimators": 50}).write.parquet(path)
    later = df.filter(F.col("timestamp") >= "2024-01-15")
    return result(det.get(*FOREST).score(spark.read.parquet(path), later), "is_outlier")
