"""Detectors against row-by-row recomputation and by their properties."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddledger.errors import AnalysisError, ConfigError
from oddledger.operators import detectors as det
from oddledger.operators.detectors import correlation, iforest, timeseries
from oddledger.operators.fusion import fuse
from oddledger.plans import strategy


def txns(spark, amounts, accounts=None, start="2023-01-01", hours=None):
    n = len(amounts)
    step = hours if hours is not None else np.arange(n)
    pdf = pd.DataFrame(
        {
            "id": [f"T{i:05d}" for i in range(n)],
            "account_id": accounts if accounts is not None else ["A"] * n,
            "amount": np.asarray(amounts, float),
            "timestamp": pd.Timestamp(start) + pd.to_timedelta(step, unit="h"),
        }
    )
    return spark.createDataFrame(pdf), pdf


def scores(df):
    return df.select("transaction_id", "score", "confidence").toPandas().set_index("transaction_id")


def test_rolling_zscore_row_by_row(spark):
    amounts = np.random.default_rng(42).normal(100, 20, 100)
    amounts[[0, 1]] = 500, -200
    df, pdf = txns(spark, amounts)
    found = scores(det.get("statistical", "zscore").run(df))
    for i in range(100):
        prior = amounts[max(0, i - 29):i]
        spread = prior.std(ddof=1) if len(prior) > 1 else 0
        z = abs((amounts[i] - prior.mean()) / spread) if spread else 0.0
        row = found.loc[f"T{i:05d}"]
        assert row["score"] == pytest.approx(z, abs=1e-9)
        assert row["confidence"] == pytest.approx(min(1, z / 3), abs=1e-9)


def test_zscore_outliers_of_their_account(spark):
    amounts, accounts = [], []
    for name, level, odd in (("A", 100, 500), ("B", 200, 800), ("C", 50, 200)):
        amounts += [odd] + list(np.random.default_rng(1).normal(level, 5, 19))
        accounts += [name] * 20
    df, pdf = txns(spark, amounts, accounts)
    found = scores(det.get("statistical", "zscore").run(df))
    assert set(found["score"].nlargest(3).index) == {"T00000", "T00020", "T00040"}


def test_zscore_constant_small_and_single(spark):
    zscore = det.get("statistical", "zscore")
    assert scores(zscore.run(txns(spark, [100.0] * 20)[0]))["score"].max() == 0
    assert zscore.run(txns(spark, [100.0, 110.0])[0]).count() == 0
    with pytest.raises(AnalysisError):
        zscore.run(txns(spark, [1.0])[0])


@pytest.mark.parametrize(
    "kind,name,config",
    [
        ("statistical", "zscore", {"threshold": 0}),
        ("statistical", "zscore", {"window_size": 1}),
        ("statistical", "correlation", {"window_size": 5}),
        ("statistical", "correlation", {"correlation_type": "other"}),
        ("statistical", "correlation", {"features": ["amount"]}),
        ("statistical", "timeseries", {"time_window": "month"}),
        ("statistical", "timeseries", {"min_periods": 2}),
        ("rule_based", "weekend_threshold", {"amount_percentile": 100}),
        ("rule_based", "weekend_threshold", {"weekend_multiplier": -1}),
        ("ml_based", "isolation_forest", {"contamination": 0.6}),
        ("ml_based", "isolation_forest", {"max_samples": 1.5}),
        ("ml_based", "isolation_forest", {"min_samples_fit": 5}),
    ],
)
def test_bad_configs(kind, name, config):
    with pytest.raises(ConfigError):
        det.get(kind, name).merged(config)


def test_registry():
    with pytest.raises(ConfigError):
        det.get("statistical", "nothing")
    names = {d["name"] for d in det.list_detectors("statistical")}
    assert {"zscore", "correlation", "timeseries"} <= names


def _ranks(x):
    return pd.Series(x).rank().to_numpy()


def _kendall(x, y):
    s = sx = sy = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = np.sign(x[j] - x[i]), np.sign(y[j] - y[i])
        s, sx, sy = s + a * b, sx + abs(a), sy + abs(b)
    return s / np.sqrt(sx * sy) if sx and sy else np.nan


@pytest.mark.parametrize("ranks", [True, False])
def test_moving_rank_correlation(ranks):
    rng = np.random.default_rng(3)
    values = [rng.integers(0, 6, 70).astype(float), rng.integers(0, 4, 70).astype(float), np.ones(70)]
    found = correlation.moving_block(values, 7, "spearman" if ranks else "kendall")
    for i in range(70):
        cut = slice(max(0, i - 7), i + 8)
        x, y = values[0][cut], values[1][cut]
        want = np.corrcoef(_ranks(x), _ranks(y))[0, 1] if ranks else _kendall(x, y)
        assert found["_r0_1"][i] == pytest.approx(want, abs=1e-12, nan_ok=True)
        assert found["_m0"][i] == pytest.approx(x.mean())
        assert found["_s0"][i] == pytest.approx(x.std())
        assert found["_rows"][i] == len(x)
    assert np.isnan(found["_r0_2"]).all()


@pytest.mark.parametrize("kind", ["pearson", "spearman", "kendall"])
def test_frames_end_at_account_borders(kind):
    rng = np.random.default_rng(5)
    border = np.zeros(300, bool)
    border[[0, 1, 2, 40, 41, 180]] = True
    values = [rng.lognormal(2, 2, 300), rng.integers(0, 5, 300).astype(float)]
    values[0][[3, 50, 51, 52, 200]] = np.nan
    found = correlation.moving_block(values, 9, kind, border)
    starts = np.flatnonzero(border)
    for a, e in zip(starts, [*starts[1:], 300]):
        alone = correlation.moving_block([v[a:e] for v in values], 9, kind)
        for name, column in alone.items():
            np.testing.assert_allclose(found[name][a:e], column, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-12, 0.0), (1.0, 1e9)])
def test_moving_moments_do_not_cancel(scale, offset):
    rng = np.random.default_rng(6)
    x = np.round(rng.lognormal(1, 1, 400), 2)
    x[200] = 1e7  # frames without it keep all their digits
    x = x * scale + offset
    y = rng.integers(0, 24, 400).astype(float)
    left, right = np.maximum(np.arange(400) - 20, 0), np.minimum(np.arange(400) + 20, 399)
    size, means, co = correlation.moving_moments([x, y], left, right)
    for i in range(400):
        a, b = x[left[i] : right[i] + 1], y[left[i] : right[i] + 1]
        assert size[i] == len(a) and means[0][i] == pytest.approx(a.mean(), rel=1e-14)
        assert co[0, 0][i] / size[i] == pytest.approx(a.var(), rel=1e-7)
        assert co[0, 1][i] / size[i] == pytest.approx(np.cov(a, b, bias=True)[0, 1], rel=1e-6, abs=1e-9 * a.std())


def test_batches_of_any_size_give_one_result(monkeypatch):
    rng = np.random.default_rng(8)
    accounts = np.sort(rng.integers(0, 6, 500)).astype(str)
    accounts[:260] = "0"
    table = pa.table(
        {
            "id": [f"T{i}" for i in range(500)],
            "_n": np.full(500, 9),
            "_f0": rng.integers(0, 9, 500).astype(float),
            "_f1": rng.random(500),
            "account_id": accounts,
            "_block": np.zeros(500, np.int64),
            "_own": rng.random(500) < 0.9,
        }
    )
    kept = ["id", "_n", "_f0", "_f1"]
    added = ["_rows", "_m0", "_m1", "_s0", "_s1", "_c0_1", "_r0_1"]

    def run(chunk, batch):
        monkeypatch.setattr(correlation, "CHUNK", chunk)
        parts = correlation._moving_batches(
            iter(table.to_batches(batch)), kept, added, 2, 10, "spearman"
        )
        return pa.Table.from_batches(parts).to_pandas()

    whole = run(10_000, 500)
    assert list(whole["id"]) == [i for i, own in zip(table["id"].to_pylist(), table["_own"].to_pylist()) if own]
    for chunk, batch in ((40, 7), (64, 33), (100, 500)):
        pd.testing.assert_frame_equal(run(chunk, batch), whole)
    assert list(correlation._moving_batches(iter([]), kept, added, 2, 10, "pearson")) == []


@pytest.mark.parametrize("kind", ["pearson", "spearman", "kendall"])
def test_broken_relation_scores_high(spark, kind):
    hours = np.arange(200)
    amounts = (hours % 24) * 10.0 + 5
    amounts[100] = 400
    found = scores(
        det.get("statistical", "correlation").run(
            txns(spark, amounts)[0],
            {"features": ["amount", "hour"], "window_size": 40, "correlation_type": kind},
        )
    )
    assert found["score"].idxmax() == "T00100"


def test_timing_patterns(spark):
    hours = list(np.arange(0, 400, 10.0)) + [390.05, 1500.0]
    found = timeseries.account_timing(
        txns(spark, [10.0] * len(hours), hours=np.array(hours))[0], None
    ).select("id", "timing_pattern", "a_score").toPandas().set_index("id")
    assert found.loc["T00000", "timing_pattern"] == "first_transaction"
    assert found.loc["T00040", "timing_pattern"] == "rapid_transaction"
    assert found.loc["T00041", "timing_pattern"] == "delayed_transaction"
    assert found.loc["T00001", "timing_pattern"] == "normal"


def test_busy_hour_is_flagged(spark):
    hours = np.concatenate([np.arange(0, 100), np.full(60, 50) + np.arange(60) / 1000])
    df, pdf = txns(spark, np.full(160, 10.0), [f"A{i}" for i in range(160)], hours=hours)
    found = scores(det.get("statistical", "timeseries").run(df, {"seasonal_adjustment": False}))
    assert (found.loc[[f"T{i:05d}" for i in range(100, 160)], "score"] == 1.0).all()
    assert found.loc["T00003", "score"] == 0.1


def test_few_periods_give_constant(spark):
    found = scores(det.get("statistical", "timeseries").run(txns(spark, [1.0] * 20, [f"A{i}" for i in range(20)], hours=np.zeros(20))[0]))
    assert set(found["score"]) == {0.1} and set(found["confidence"]) == {0.2}


def test_large_saturday_night(spark):
    hours = list(np.arange(24, 24 * 5, 4.0)) + [24 * 6 + 3]
    amounts = [100.0] * (len(hours) - 1) + [5000.0]
    found = det.get("rule_based", "weekend_threshold").run(txns(spark, amounts, hours=np.array(hours))[0])
    row = found.orderBy(F.desc("score")).first()
    assert row["transaction_id"] == f"T{len(hours) - 1:05d}" and row["score"] == 1.0
    assert set(row["metadata"]["violations"]) == {
        "amount_threshold", "weekday_threshold", "unusual_weekend_hour"
    }


def test_weekend_without_weekdays(spark):
    found = scores(det.get("rule_based", "weekend_threshold").run(txns(spark, [5.0] * 12, start="2023-01-07")[0]))
    assert set(found["score"]) == {0.1} and found["confidence"].max() == pytest.approx(0.3)


# -- isolation forest ------------------------------------------------------------


def _forest_rows(spark, n=1500):
    amounts = np.random.default_rng(0).normal(100, 10, n)
    amounts[:5] = 5000
    return txns(spark, amounts, [f"A{i % 3}" for i in range(n)])[0]


def test_forest_properties(spark):
    forest = det.get("ml_based", "isolation_forest")
    config = {"n_estimators": 60}
    found = forest.run(_forest_rows(spark), config)
    pdf = found.select("transaction_id", "score", "confidence", "metadata.is_outlier").toPandas()
    assert set(pdf.nlargest(5, "score")["transaction_id"]) == {f"T{i:05d}" for i in range(5)}
    assert pdf["is_outlier"].mean() == pytest.approx(0.1, abs=0.02)
    assert pdf["score"].between(0.01, 0.99).all() and pdf["confidence"].between(0.1, 0.95).all()
    again = forest.run(_forest_rows(spark).repartition(5), config).toPandas()
    a, b = pdf.set_index("transaction_id")["score"], again.set_index("transaction_id")["score"]
    assert (a - b.loc[a.index]).abs().max() < 1e-12  # whatever the partitioning


def test_forest_per_account(spark):
    forest = det.get("ml_based", "isolation_forest")
    small = txns(spark, [1.0] * 10, ["tiny"] * 10)[0].withColumn("id", F.concat(F.lit("S"), "id"))
    found = forest.run(
        _forest_rows(spark).unionByName(small), {"account_specific": True, "n_estimators": 30}
    ).toPandas().set_index("transaction_id")
    assert len(found) == 1510
    tiny = found[found.index.str.startswith("S")]
    assert set(tiny["score"]) == {0.1} and set(tiny["confidence"]) == {0.3}
    assert found["score"].nlargest(5).index.str.match("T0000[0-4]").all()


def test_forest_saved_model_scores_later_rows(spark, tmp_path):
    forest = det.get("ml_based", "isolation_forest")
    forest.fit(_forest_rows(spark), {"n_estimators": 40}).write.parquet(str(tmp_path / "m"))
    model = spark.read.parquet(str(tmp_path / "m"))
    later = txns(spark, [100.0, 101.0, 9000.0])[0]
    found = scores(forest.score(model, later))
    assert found["score"].idxmax() == "T00002"
    with pytest.raises(AnalysisError):
        forest.score(model, later.drop("amount"))


def test_forest_few_rows_nulls_and_weekday_names(spark):
    forest = det.get("ml_based", "isolation_forest")
    found = scores(forest.run(txns(spark, [1.0] * 20)[0]))
    assert set(found["score"]) == {0.1} and set(found["confidence"]) == {0.2}
    df = _forest_rows(spark, 300).withColumns(
        {
            "extra": F.when(F.rand(1) > 0.2, F.rand(2)),
            "hour": F.hour("timestamp"),
            "is_weekend": F.lit(False),
            "day_of_week": F.date_format("timestamp", "EEEE"),
        }
    )
    config = {"features": ["amount", "extra", "day_of_week"], "n_estimators": 20}
    assert forest.run(df, config).filter("score is null").count() == 0


def _drawn_points(n=300, kinds=3, seed=5):
    points = np.random.default_rng(seed).normal(size=(n, kinds)).round(2)
    points[:, -1] = 7.0  # a feature that never varies is never cut
    return points


def test_tree_paths_cover_all_points():
    points = _drawn_points()
    of = np.repeat(np.arange(50), 128)
    at = np.concatenate([np.random.default_rng(i).permutation(300)[:128] for i in range(50)])
    roots = iforest.Roots(np.arange(50), np.ones(50, int), np.zeros(50, int), np.full(50, 7))
    trees = iforest.grow_roots(points[at], of, roots, 42)
    for tree, rows in zip(trees, np.split(at, 50), strict=True):
        inner = tree["feature"] >= 0
        assert not (tree["feature"] == 2).any()
        # every cut has two children, and the leaves hold all points of the sample
        assert sorted(np.concatenate([tree["child"][inner], tree["child"][inner] + 1])) == list(range(1, len(inner)))
        assert iforest.path_sums(points[rows], [tree]).min() >= 1
    far = np.vstack([points, [[9, 9, 9]]])
    s = iforest.anomaly_value(iforest.path_sums(far, trees), 50, 128)
    assert s.argmax() == 300 and 0 < s.min() and s.max() < 1


def test_draws_are_those_of_spark(spark):
    salts = np.array([0, 5, -7, 2**62, -(2**61)])
    nodes = np.array([1, 2, 3, 2**40 + 1, 2**61])
    rows = [(int(s), i, int(n)) for i, (s, n) in enumerate(zip(salts, nodes, strict=True))]
    df = spark.createDataFrame(rows, "_salt long, tree int, node long")
    for which in (0, 1):
        got = [r[0] for r in df.orderBy("tree").select(iforest.node_draw_column(42, which)).collect()]
        assert got == iforest.node_draws(42, salts, np.arange(5), nodes, which).tolist()
        assert all(0 <= v < 1 for v in got)


def _trees(model):
    parts = {}
    for r in model.select(*iforest.PART).collect():
        parts.setdefault(r["tree"], {})[r["root"]] = {k: np.asarray(r[k]) for k in iforest.NODES}
    return [iforest.whole_tree(parts[t]) for t in sorted(parts)]


def _shape(tree, at=0):
    f = int(tree["feature"][at])
    if f < 0:
        return round(float(tree["path"][at]), 9)
    c = int(tree["child"][at])
    return f, float(tree["threshold"][at]), _shape(tree, c), _shape(tree, c + 1)


@pytest.fixture
def task_rows(spark):
    from oddledger.session import GROUP_ROWS_CONF

    yield lambda n: spark.conf.set(GROUP_ROWS_CONF, str(n))
    spark.conf.unset(GROUP_ROWS_CONF)


def test_large_samples_give_the_same_trees(spark, task_rows, monkeypatch):
    """However a tree is cut up while it grows, and whichever way rows meet it."""
    forest = det.get("ml_based", "isolation_forest")
    df = _forest_rows(spark, 600)
    config = {"n_estimators": 5, "max_samples": 0.5}
    whole = forest.fit(df, config)
    want = scores(forest.run(df, config))
    task_rows(60)
    parted = forest.fit(df, config)
    assert whole.count() == 5 < parted.count()
    assert [_shape(t) for t in _trees(whole)] == [_shape(t) for t in _trees(parted)]
    assert (scores(forest.run(df, config)) - want).abs().max().max() < 1e-9
    # bundles of several trees, and trees larger than a bundle
    for nodes in (500, 100):
        monkeypatch.setattr(iforest, "FOREST_NODES", nodes)
        assert iforest.forest_nodes(parted) > nodes
        assert (scores(forest.score(parted, df)) - want).abs().max().max() < 1e-9
        assert (scores(forest.score(whole, df)) - want).abs().max().max() < 1e-9


def test_large_samples_per_account(spark, task_rows, monkeypatch):
    forest = det.get("ml_based", "isolation_forest")
    df = _forest_rows(spark, 300).unionByName(
        txns(spark, np.random.default_rng(3).normal(5, 1, 60), ["small"] * 60)[0].withColumn("id", F.concat(F.lit("S"), "id"))
    )
    config = {"account_specific": True, "n_estimators": 4, "max_samples": 0.9}
    want = scores(forest.run(df, config))
    task_rows(40)
    assert (scores(forest.run(df, config)) - want).abs().max().max() < 1e-9
    monkeypatch.setattr(iforest, "FOREST_NODES", 70)
    assert (scores(forest.run(df, config)) - want).abs().max().max() < 1e-9


def test_ordinary_accounts_are_not_copied_for_every_tree(spark, monkeypatch):
    """Their trees are grown and walked where the rows lie; only hot accounts go the long way."""
    forest = det.get("ml_based", "isolation_forest")
    # accounts of 80 rows, all in every tree, and of 600 rows, sampled
    values = np.random.default_rng(8).normal(20, 4, 1240).round(2)
    owners = [f"a{i % 8}" for i in range(640)] + ["b"] * 600
    df = txns(spark, values, owners)[0]
    config = {"account_specific": True, "n_estimators": 6}
    spark.conf.set("spark.oddledger.groupRows", "50")
    try:
        want = scores(forest.run(df, config))
    finally:
        spark.conf.unset("spark.oddledger.groupRows")

    def never(*args, **kwargs):
        raise AssertionError("rows copied for every tree")

    monkeypatch.setattr(iforest, "sample_rows", never)
    monkeypatch.setattr(iforest, "_score_by_parts", never)
    assert (scores(forest.run(df, config)) - want).abs().max().max() < 1e-9


@pytest.mark.parametrize("rows,points", [(1, 1), (7, 40), (1000, 10**6)])
def test_accounts_in_batches_of_any_size(monkeypatch, rows, points):
    """Batches cut accounts anywhere; a task's tables hold whole ones, and each tree is its own."""
    monkeypatch.setattr(iforest, "ACCOUNT_ROWS", rows)
    monkeypatch.setattr(iforest, "ACCOUNT_POINTS", points)
    sizes = np.array([5, 1, 30, 2, 64, 12])
    drawn = np.random.default_rng(2).normal(size=(sizes.sum(), 2)).round(1)
    own_psi = np.where(sizes == 64, 16, sizes)
    per_row = [np.repeat(x, sizes) for x in (sizes, own_psi, np.arange(6) * 977)]
    lists = [list(range(3)) if k == 64 else None for k in per_row[0]]
    orders = [[(i * 37 + t * 11) % 101 for t in x] if x else None for i, x in enumerate(lists)]
    table = pa.table(
        {
            "_n": per_row[0], "_psi": per_row[1], "_salt": per_row[2],
            "_trees": pa.array(lists, pa.list_(pa.int32())), "_order": pa.array(orders, pa.list_(pa.int64())),
            "_x0": drawn[:, 0], "_x1": drawn[:, 1],
        }
    )
    got, met = [], []
    for part, own in iforest._whole_accounts(iter(table.to_batches(max_chunksize=9))):
        assert part.num_rows == own.sum()
        met.extend(own)
        got.append(iforest.account_values(part, own, ["_x0", "_x1"], 3, 42))
    assert met == sizes.tolist()
    want, at = [], 0
    for i, k in enumerate(sizes):
        mine, rank = np.arange(at, at + k), np.arange(k)
        paths = np.zeros(k)
        for t in range(3):
            if k == 64:
                rank = np.argsort([orders[j][t] for j in mine], kind="stable")[:16]
            limit = int(max(own_psi[i], 2) - 1).bit_length()
            roots = iforest.Roots(*(np.array([x]) for x in (t, 1, i * 977, limit)))
            tree = iforest.grow_roots(drawn[mine[rank]], np.zeros(len(rank), int), roots, 42)
            paths += iforest.path_sums(drawn[mine], tree)
        want.append(iforest.anomaly_value(paths, 3, own_psi[i]))
        at += k
    assert np.abs(np.concatenate(got) - np.concatenate(want)).max() < 1e-12


def test_strategy_keeps_a_forest_with_large_samples(spark, task_rows):
    task_rows(1000)
    plan = {
        "algorithms": [
            {"type": "ml_based", "name": "isolation_forest", "enabled": True,
             "config": {"max_samples": 0.5, "n_estimators": 3}},
            {"type": "statistical", "name": "zscore", "enabled": True},
        ]
    }
    run = strategy.plan_strategy(_forest_rows(spark, 3000), plan)
    assert run.detectors[0] == ("ml_based", "isolation_forest") and not run.skipped
    assert run.scores.filter("algorithm_type = 'ml_based'").count() == 3000


def test_large_forest_on_a_stream(spark, tmp_path, monkeypatch):
    from oddledger.streaming.score import score_stream, start_scoring

    forest = det.get("ml_based", "isolation_forest")
    df = _forest_rows(spark, 400)
    model = forest.fit(df, {"n_estimators": 5})
    want = scores(forest.score(model, df))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    monkeypatch.setattr(iforest, "FOREST_NODES", 200)
    with pytest.raises(AnalysisError):
        score_stream(model, stream)
    start_scoring(model, stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = scores(spark.read.parquet(str(tmp_path / "out")))
    assert (got - want).abs().max().max() < 1e-9


# -- fusion and strategies ---------------------------------------------------------


def _scores(spark):
    rows = [
        ("t1", "statistical", "zscore", 0, 0.9, 0.5), ("t1", "rule_based", "weekend_threshold", 1, 0.9, 0.8),
        ("t1", "ml_based", "isolation_forest", 2, 0.3, 0.1), ("t2", "rule_based", "weekend_threshold", 1, 0.2, 0.4),
    ]
    names = "transaction_id string, algorithm_type string, algorithm_name string, ordinal int, score double, confidence double"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize(
    "method,weights,score,confidence",
    [
        ("max", None, 0.9, 0.5),
        ("min", None, 0.3, 0.1),
        ("mean", None, 0.7, 1.4 / 3),
        ("weighted_average", {"statistical": 2.0, "ml_based": 0.0}, (1.8 + 0.9) / 3, (1.0 + 0.8) / 3),
    ],
)
def test_fuse(spark, method, weights, score, confidence):
    found = {r["transaction_id"]: r for r in fuse(_scores(spark), method, 0.7, weights).collect()}
    assert found["t1"]["final_score"] == pytest.approx(score)
    assert found["t1"]["final_confidence"] == pytest.approx(confidence)
    assert found["t1"]["is_anomaly"] == (score >= 0.7)
    assert found["t2"]["algorithms_used"] == ["rule_based.weekend_threshold"]
    assert found["t2"]["individual_scores"] == {"rule_based.weekend_threshold": 0.2}
    assert found["t2"]["final_score"] == pytest.approx(0.2)


def test_fuse_zero_weights_and_unknown_method(spark):
    weights = {"statistical": 0, "rule_based": 0, "ml_based": 0}
    assert fuse(_scores(spark), "weighted_average", 0.7, weights).first()["final_score"] == 0.0
    with pytest.raises(ConfigError):
        fuse(_scores(spark), "median")


def test_strategy_skips_what_cannot_run(spark):
    df = txns(spark, list(range(1, 13)))[0]
    plan = {
        "algorithms": [
            {"type": "statistical", "name": "correlation", "enabled": True},  # needs 20 rows
            {"type": "statistical", "name": "zscore", "enabled": True},
            {"type": "rule_based", "name": "weekend_threshold", "enabled": False},
        ]
    }
    run = strategy.plan_strategy(df, plan)
    assert run.detectors == [("statistical", "zscore")]
    assert list(run.skipped) == ["statistical.correlation"]
    listed = strategy.summarise(df, plan).first()["algorithms_skipped"]
    assert listed == run.skipped
    with pytest.warns(UserWarning, match="correlation"):
        said = strategy.analyse(df, plan).first()["algorithms_skipped"]
    assert len(said) == 1 and said[0].startswith("statistical.correlation: ")
    report = {r["detector"]: r["ran"] for r in strategy.run_report(run, spark).collect()}
    assert report == {"statistical.zscore": True, "statistical.correlation": False}
    with pytest.raises(AnalysisError):
        strategy.plan_strategy(df, {"algorithms": plan["algorithms"][:1]})


def test_check_strategy():
    for name, valid in (
        ("Basic Statistical Detection", True), ("Comprehensive Multi-Algorithm", True), ("Rule-Based Only", False)
    ):
        assert strategy.check_strategy(strategy.PRESETS[name])["valid"] is valid
    bad = {
        "algorithms": [{"type": "statistical", "name": "zscore", "enabled": True, "config": {"threshold": -1}}],
        "global_settings": {"aggregation_method": "median", "confidence_threshold": 2},
    }
    assert len(strategy.check_strategy(bad)["errors"]) == 3
    assert not strategy.check_strategy([])["valid"]
    assert not strategy.check_strategy({"algorithms": []})["valid"]


def test_tune_changes_a_copy(spark):
    plan = {
        "algorithms": [
            {"type": "statistical", "name": "zscore", "config": {"threshold": 3.0, "window_size": 30}},
            {"type": "rule_based", "name": "weekend_threshold", "config": {}},
            {"type": "ml_based", "name": "isolation_forest", "config": {}},
        ],
        "global_settings": {"confidence_threshold": 0.8},
    }
    stats = {"transaction_count": 50, "outlier_potential": 0.2, "weekend_ratio": 0.05, "completeness": 0.5}
    facts = spark.createDataFrame([stats])
    tuned = strategy.with_tuning(plan, strategy.tuning(plan, facts))
    assert strategy.tuning(plan, facts.drop("weekend_ratio")).count() == 5
    assert tuned["algorithms"][0]["config"] == {"threshold": pytest.approx(2.4), "window_size": 10}
    assert tuned["algorithms"][1]["config"] == {"weekend_multiplier": pytest.approx(0.15)}
    assert tuned["algorithms"][2]["config"] == {"contamination": 0.05, "n_estimators": 50}
    assert tuned["global_settings"]["confidence_threshold"] == pytest.approx(0.9)
    assert plan["algorithms"][0]["config"] == {"threshold": 3.0, "window_size": 30}
