"""Split paths for hot keys give the same rows as plain windows."""

import pytest
from pyspark.sql import functions as F

from oddledger.operators import groups as g
from oddledger.operators.detectors import Transactions, get
from oddledger.plans.strategy import analyse
from oddledger.session import GROUP_ROWS_CONF


def skewed(spark, rows=3000):
    """A third of all rows, many at the same time and amount, in one account."""
    key = F.when(F.col("n") % 3 == 0, "big").otherwise(F.concat(F.lit("a"), F.col("n") % 40))
    hour = F.when(F.col("n") % 9 == 0, F.lit(100)).otherwise(F.pmod(F.xxhash64("n"), F.lit(900)))
    return spark.range(rows).withColumnRenamed("id", "n").select(
        F.col("n").cast("string").alias("id"),
        key.alias("account_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), hour.cast("int"))).alias(
            "timestamp"
        ),
        F.when(F.col("n") % 6 == 0, 50.0)
        .otherwise(F.pmod(F.xxhash64("n", F.lit(7)), F.lit(100000)) / 100.0)
        .alias("amount"),
    )


def rounded(df):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else c for c in df.columns])


def same(a, b):
    a, b = rounded(a), rounded(b.select(a.columns))
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_hot_keys_found(spark, small_groups):
    hot = g.hot_keys(skewed(spark), "account_id")
    sizes = {r["account_id"]: r["count"] for r in skewed(spark).groupBy("account_id").count().collect()}
    want = {a for a, n in sizes.items() if n > small_groups}
    assert "big" in want and {r[0] for r in hot.table.collect()} == want
    cold, large = hot.split(skewed(spark))
    assert large.count() == sum(sizes[a] for a in want)
    assert cold.count() == sum(n for a, n in sizes.items() if a not in want)


def test_hot_is_a_matter_of_rows_alone(spark):
    df = spark.range(8000).select(
        F.when(F.col("id") < 900, "big").otherwise(F.col("id").cast("string")).alias("account_id")
    )
    for parts in ("2", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set(GROUP_ROWS_CONF, "10")
        try:
            assert [r[0] for r in g.hot_keys(df, "account_id").table.collect()] == ["big"]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset(GROUP_ROWS_CONF)


def test_no_hot_keys_by_default(spark):
    assert not g.hot_keys(skewed(spark), "account_id")


def test_ordered_columns(spark, small_groups):
    df = skewed(spark)
    found = g.ordered_columns(
        df, "account_id", ["timestamp", "id"],
        {
            "before": lambda w: F.avg("amount").over(w.rowsBetween(-7, -1)),
            "around": lambda w: F.sum("amount").over(w.rowsBetween(-5, 5)),
        },
        before=7, after=5, sequence="seq",
    )
    w = "partition by account_id order by timestamp, id"
    plain = df.withColumns(
        {
            "before": F.expr(f"avg(amount) over ({w} rows between 7 preceding and 1 preceding)"),
            "around": F.expr(f"sum(amount) over ({w} rows between 5 preceding and 5 following)"),
            "seq": F.expr(f"cast(row_number() over ({w}) as bigint)"),
        }
    )
    same(found, plain)


def test_global_order(spark, small_groups):
    df = skewed(spark)
    found = g.global_ordered_columns(
        df, ["timestamp", "id"],
        {"m": lambda w: F.avg("amount").over(w.rowsBetween(-9, -1))}, before=9,
    )
    plain = df.withColumn(
        "m", F.expr("avg(amount) over (order by timestamp, id rows between 9 preceding and 1 preceding)")
    )
    same(found, plain)


def test_positions_are_exact(spark):
    df = g.position_rows(skewed(spark), ["account_id"], ["amount", "id"], "pos")
    plain = skewed(spark).withColumn(
        "pos",
        F.expr("cast(row_number() over (partition by account_id order by amount, id) as bigint)"),
    )
    same(df, plain)


def test_key_statistics(spark, small_groups):
    df = skewed(spark)
    found = g.key_columns(
        df, "account_id", {"n": F.count("amount"), "sd": F.stddev_samp("amount")},
        {"q": ("amount", 0.37), "m": ("amount", 0.5)},
    )
    by = "over (partition by account_id)"
    plain = df.withColumns(
        {
            "n": F.expr(f"count(amount) {by}"),
            "sd": F.expr(f"stddev_samp(amount) {by}"),
            "q": F.expr(f"percentile(amount, 0.37) {by}"),
            "m": F.expr(f"percentile(amount, 0.5) {by}"),
        }
    )
    same(found, plain)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.77, 1.0])
def test_sorted_quantiles(spark, small_groups, p):
    df = skewed(spark)
    found = g.global_quantiles(df, "amount", {"q": p}).first()["q"]
    assert found == pytest.approx(df.agg(F.percentile("amount", F.lit(p))).first()[0])


def test_table_stats_paths_agree(spark):
    df = skewed(spark)
    args = ({"n": F.count("amount"), "m": F.avg("amount")}, {"a": ("amount", 0.2), "b": ("amount", 0.9)})
    one = g.table_stats(df, *args).first()
    spark.conf.set(GROUP_ROWS_CONF, "40")
    try:
        two = g.table_stats(df, *args).first()
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert one.asDict() == pytest.approx(two.asDict())


CASES = [
    ("statistical", "zscore", {}),
    ("statistical", "zscore", {"use_rolling_window": False}),
    ("statistical", "zscore", {"account_specific": False}),
    ("statistical", "correlation", {"window_size": 20}),
    ("statistical", "correlation", {"window_size": 20, "correlation_type": "kendall"}),
    ("statistical", "timeseries", {"aggregation_method": "sum"}),
    ("statistical", "timeseries", {"threshold_method": "iqr"}),
    ("rule_based", "weekend_threshold", {}),
    ("rule_based", "weekend_threshold", {"amount_threshold_method": "median_iqr"}),
    (
        "ml_based", "isolation_forest",
        {"account_specific": True, "n_estimators": 5, "min_samples_fit": 20, "max_samples": 32},
    ),
    ("ml_based", "isolation_forest", {"n_estimators": 5, "max_samples": 32}),
]


@pytest.mark.parametrize("kind,name,config", CASES)
def test_detectors_do_not_depend_on_the_split(spark, kind, name, config):
    columns = ["transaction_id", "score", "confidence"]
    plain = get(kind, name).run(skewed(spark), config).select(columns).toPandas()
    spark.conf.set(GROUP_ROWS_CONF, "40")
    try:
        split = get(kind, name).run(Transactions(skewed(spark)), config).select(columns).toPandas()
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    a = plain.set_index("transaction_id").sort_index()
    b = split.set_index("transaction_id").sort_index()
    assert list(a.index) == list(b.index)
    assert abs(a - b).max().max() < 1e-6


def test_whole_strategy_under_skew(spark, small_groups):
    assert analyse(skewed(spark)).count() == 3000


def test_quantiles_of_all_columns_take_one_exchange(spark, small_groups):
    """The number of jobs does not follow the number of columns."""
    from oddledger.operators.groups import table_stats

    df = spark.range(500).selectExpr(
        "id % 97 as a", "id * 0.5 as b", "if(id % 3 = 0, null, id) as c", "cast(7 as double) as d", "-id as e"
    )
    sc = spark.sparkContext
    jobs, found = [], []
    for names in (["a", "b"], ["a", "b", "c", "d", "e"]):
        sc.setJobGroup(f"quantiles-{len(names)}", "")
        row = table_stats(df, {"n": F.count("a")}, {f"{c}{int(100 * p)}": (c, p) for c in names for p in (0.1, 0.5)}).first()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"quantiles-{len(names)}")))
        found.append(row)
    sc.setLocalProperty("spark.jobGroup.id", None)
    pdf = df.toPandas().astype(float)
    for c in "abcde":
        for p in (0.1, 0.5):
            assert found[1][f"{c}{int(100 * p)}"] == pytest.approx(pdf[c].quantile(p))
    assert found[1]["n"] == 500 and abs(jobs[0] - jobs[1]) <= 1
