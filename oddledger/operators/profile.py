"""Profiles of a table, mostly in long form ``(column, metric, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddledger.errors import ConfigError
from oddledger.functions.columns import hours_between, pearson, sample_kurtosis, sample_skewness
from oddledger.operators.groups import (
    HotKeys,
    global_quantiles,
    merge_rows,
    one_row,
    ordered_columns,
    table_stats,
)

NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in NUMERIC_TYPES]


def _long(row: DataFrame, cells: list[tuple[str, str, str]]) -> DataFrame:
    """One wide row to ``(column, metric, value)`` rows."""
    packed = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(metric).alias("metric"),
                F.col(source).cast("double").alias("value"),
            )
            for column, metric, source in cells
        ]
    )
    return row.select(F.inline(packed))


def missing_values(df: DataFrame) -> DataFrame:
    """NULL count and percentage per column."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    wide = wide.withColumns(
        {
            f"_p{i}": F.try_divide(F.col(f"_n{i}") * 100.0, F.col("_rows"))
            for i in range(len(df.columns))
        }
    )
    cells = []
    for i, c in enumerate(df.columns):
        cells += [(c, "missing_count", f"_n{i}"), (c, "missing_percent", f"_p{i}")]
    return _long(wide, cells)


def columns_with_missing(df: DataFrame) -> DataFrame:
    return missing_values(df).filter("metric = 'missing_count' and value > 0").select("column")


def duplicate_records(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every repeated record once, with its number of copies."""
    by = columns or df.columns
    counted = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter("copies > 1")


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    extra = duplicate_records(df, columns).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count")
    )
    row = merge_rows(df.agg(F.count(F.lit(1)).alias("rows")), extra)
    percent = F.try_divide(F.col("duplicate_count") * 100.0, F.col("rows"))
    return row.withColumn("duplicate_percent", percent)


def type_compliance(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Values that cannot be read as the expected type."""
    aggs, cells = [F.count(F.lit(1)).alias("_rows")], []
    for i, (name, kind) in enumerate(expected.items()):
        value = F.col(f"`{name}`")
        bad = value.isNotNull() & value.cast("string").try_cast(kind).isNull()
        aggs += [F.count_if(bad).alias(f"_b{i}"), F.count(value).alias(f"_v{i}")]
        cells += [(name, "violations", f"_b{i}"), (name, "values", f"_v{i}")]
    return _long(df.agg(*aggs), cells)


def numeric_outliers(
    df: DataFrame, column: str, factor: float = 1.5, rows: int | None = None
) -> DataFrame:
    """Rows outside the quartiles by more than ``factor`` times their distance."""
    quartiles = one_row(global_quantiles(df, column, {"q1": 0.25, "q3": 0.75}, rows))
    q1, q3 = quartiles.getField("q1"), quartiles.getField("q3")
    low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    bounded = df.withColumns({"lower_bound": low, "upper_bound": high})
    value = F.col(column)
    return bounded.filter((value < F.col("lower_bound")) | (value > F.col("upper_bound")))


def range_violations(
    df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], key: str = "id"
) -> DataFrame:
    """P5: one row per value outside its range."""
    checks = []
    for name, (low, high) in ranges.items():
        value = F.col(f"`{name}`")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < low)
        if high is not None:
            bad = bad | (value > high)
        hit = F.struct(F.lit(name).alias("column"), value.cast("double").alias("value"))
        checks.append(F.when(bad, hit))
    return df.select(key, F.inline(F.array_compact(F.array(*checks))))


def rule_compliance(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each named rule; a NULL outcome is a violation."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, rule in enumerate(rules.values()):
        aggs.append(F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"_b{i}"))
    packed = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"_b{i}").alias("violations"),
                (1 - F.try_divide(F.col(f"_b{i}").cast("double"), F.col("_rows"))).alias(
                    "compliance"
                ),
            )
            for i, name in enumerate(rules)
        ]
    )
    return df.agg(*aggs).select(F.inline(packed))


def reversed_times(df: DataFrame, start: str = "created_at", end: str = "processed_at"):
    """Rows whose end lies before their start."""
    return df.filter(F.col(end) < F.col(start))


def steps_back(
    df: DataFrame, key: str, sequence: str, time: str, hot: HotKeys | None = None
) -> DataFrame:
    """Rows whose time is earlier than that of the row before, per key."""
    marked = ordered_columns(
        df, key, [sequence], {"previous_time": lambda w: F.lag(time).over(w)}, before=1, hot=hot
    )
    return marked.filter(F.col(time) < F.col("previous_time"))


def time_gaps(
    df: DataFrame, key: str, time: str, hours: float, tie: str = "id", hot: HotKeys | None = None
) -> DataFrame:
    """Rows that follow their predecessor by more than ``hours``."""
    gap = lambda w: hours_between(F.col(time), F.lag(time).over(w))
    marked = ordered_columns(df, key, [time, tie], {"gap_hours": gap}, before=1, hot=hot)
    return marked.filter(F.col("gap_hours") > hours)


def time_checks(df: DataFrame, time: str, now: str) -> DataFrame:
    """First and last time and the number of future ones."""
    return df.agg(
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.count_if(F.col(time) > F.lit(now).cast("timestamp")).alias("future_count"),
    )


def suspicious_accounts(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Accounts whose amounts are all equal."""
    return (
        df.groupBy("account_id")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.min("amount").alias("amount"),
            F.max("amount").alias("_high"),
        )
        .filter((F.col("amount") == F.col("_high")) & (F.col("transaction_count") >= min_rows))
        .drop("_high")
    )


def schema_compliance(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """P10: per column required, type, range and pattern violations.

    ``spec`` maps a column to any of ``required``, ``type``, ``min``, ``max``,
    ``pattern``.  Columns outside the spec come back as ``unexpected``.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    cells = []
    for i, (name, rule) in enumerate(spec.items()):
        if name not in df.columns:
            if rule.get("required"):
                aggs.append(F.count(F.lit(1)).alias(f"_x{i}"))
                cells.append((name, "missing_column", f"_x{i}"))
            continue
        value = F.col(f"`{name}`")
        checks = {}
        if rule.get("required"):
            checks["null_required"] = value.isNull()
        if "type" in rule:
            checks["type"] = value.isNotNull() & value.cast("string").try_cast(rule["type"]).isNull()
        number = value.cast("string").try_cast("double")
        if "min" in rule:
            checks["below_min"] = number < rule["min"]
        if "max" in rule:
            checks["above_max"] = number > rule["max"]
        if "pattern" in rule:
            checks["pattern"] = ~value.cast("string").rlike(rule["pattern"])
        for kind, bad in checks.items():
            alias = f"_{kind}{i}"
            aggs.append(F.count_if(bad).alias(alias))
            cells.append((name, kind, alias))
    for name in df.columns:
        if name not in spec:
            aggs.append(F.lit(1).alias(f"_u{len(aggs)}"))
            cells.append((name, "unexpected", f"_u{len(aggs) - 1}"))
    return _long(df.agg(*aggs), cells)


def schema_changes(old: T.StructType, new: T.StructType, required: list[str]) -> list[dict]:
    """P10: column differences; breaking when a required column is added or a type changes."""
    before = {f.name: f.dataType.simpleString() for f in old}
    after = {f.name: f.dataType.simpleString() for f in new}
    changes = []
    for name, kind in after.items():
        if name not in before:
            changes.append({"column": name, "change": "added", "breaking": name in required})
        elif before[name] != kind:
            changes.append({"column": name, "change": "type", "breaking": True})
    changes += [
        {"column": name, "change": "removed", "breaking": name in required}
        for name in before
        if name not in after
    ]
    return changes


def schema_differences(old: DataFrame, new: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(column, change, breaking, filled): the columns that differ between two tables.

    ``filled`` counts the values of the column that are not NULL, in the new table or, where it
    is gone, in the old one.
    """
    changes = schema_changes(old.schema, new.schema, required or [])
    spark = new.sparkSession
    listed = spark.createDataFrame(
        [(c["column"], c["change"], c["breaking"]) for c in changes],
        "column string, change string, breaking boolean",
    )
    counts = None
    for df, gone in ((old, True), (new, False)):
        names = [c["column"] for c in changes if (c["change"] == "removed") == gone]
        if names:
            wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(names)])
            part = _long(wide, [(c, "filled", f"_f{i}") for i, c in enumerate(names)])
            counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return listed.withColumn("filled", F.lit(0).cast("long"))
    found = counts.select("column", F.col("value").cast("long").alias("filled"))
    return listed.join(F.broadcast(found), "column")


def basic_statistics(
    df: DataFrame, columns: list[str] | None = None, rows: int | None = None
) -> DataFrame:
    """Count, mean, std, min, max and median of the numeric columns."""
    names = columns or numeric_columns(df)
    if not names:
        raise ConfigError("no numeric columns to describe")
    rows = df.count() if rows is None else rows
    aggs, medians = {}, {}
    for i, c in enumerate(names):
        v = F.col(f"`{c}`").cast("double")
        aggs[f"_count{i}"] = F.count(v)
        aggs[f"_mean{i}"] = F.avg(v)
        aggs[f"_std{i}"] = F.stddev_samp(v)
        aggs[f"_min{i}"] = F.min(v)
        aggs[f"_max{i}"] = F.max(v)
        medians[f"_median{i}"] = (c, 0.5)
    wide = table_stats(df.select(*[F.col(f"`{c}`") for c in names]), aggs, medians, rows)
    metrics = ["count", "mean", "std", "min", "max", "median"]
    return _long(wide, [(c, m, f"_{m}{i}") for i, c in enumerate(names) for m in metrics])


def time_statistics(df: DataFrame, column: str) -> DataFrame:
    """First, last, span in days and number of distinct days."""
    at = F.col(column)
    return df.agg(
        F.min(at).alias("first_time"),
        F.max(at).alias("last_time"),
        F.floor((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 86_400_000_000).alias(
            "span_days"
        ),
        F.countDistinct(F.to_date(at)).alias("distinct_days"),
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from minimum to maximum; the last one is closed."""
    value = F.col(f"`{column}`").cast("double")
    ends = one_row(df.agg(F.min(value).alias("low"), F.max(value).alias("high")))
    low, high = ends.getField("low"), ends.getField("high")
    slot = F.when(high == low, 0).otherwise(
        F.least(F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(bins - 1))
    )
    counted = (
        df.filter(value.isNotNull())
        .select(slot.cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spark = df.sparkSession
    slots = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return slots.join(counted, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("lower"),
        (low + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def distribution(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Percentiles, skewness and kurtosis (sample-corrected)."""
    value = F.col(f"`{column}`").cast("double")
    shape = {"skewness": sample_skewness(value), "kurtosis": sample_kurtosis(value)}
    wide = table_stats(df, shape, {n: (column, p) for n, p in PERCENTILES.items()}, rows)
    return _long(wide, [(column, m, m) for m in ["skewness", "kurtosis", *PERCENTILES]])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, all in one aggregation."""
    names = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    aggs = [
        pearson(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"_r{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_r{i}").alias("correlation")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("left"), F.lit(a).alias("right"), F.col(f"_r{i}").alias("correlation")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def temporal_patterns(df: DataFrame, column: str) -> DataFrame:
    """Counts by hour, weekday, week and month in one pass."""
    at = F.col(column)
    parts = F.array(
        F.struct(F.lit("hour").alias("unit"), F.hour(at).alias("slot")),
        F.struct(F.lit("weekday").alias("unit"), F.weekday(at).alias("slot")),
        F.struct(F.lit("week").alias("unit"), F.weekofyear(at).alias("slot")),
        F.struct(F.lit("month").alias("unit"), F.month(at).alias("slot")),
    )
    fine = (
        df.filter(at.isNotNull())
        .groupBy(F.date_trunc("hour", at).alias(column))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # the hourly counts are few; only they are spread over the four units
    return (
        fine.select("_n", F.inline(parts)).groupBy("unit", "slot").agg(F.sum("_n").alias("count"))
    )


def categorical_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value."""
    value = F.col(f"`{column}`")
    total = df.agg(F.count(value).alias("n")).scalar()
    return (
        df.filter(value.isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("percent", F.col("count") * 100.0 / total)
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct values per column."""
    wide = df.agg(*[F.countDistinct(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(columns)])
    return _long(wide, [(c, "distinct", f"_d{i}") for i, c in enumerate(columns)])


def compare_statistics(left: DataFrame, right: DataFrame, columns: list[str] | None = None):
    """The statistics of two tables side by side."""
    a = basic_statistics(left, columns).withColumnRenamed("value", "left_value")
    b = basic_statistics(right, columns).withColumnRenamed("value", "right_value")
    return a.join(b, ["column", "metric"], "full_outer").withColumn(
        "difference", F.col("right_value") - F.col("left_value")
    )
