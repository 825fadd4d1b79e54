"""Strategies: which detectors run, how, and how their scores are fused."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddledger.errors import AnalysisError, ConfigError
from oddledger.functions.columns import sample_skewness
from oddledger.operators.detectors import Transactions, get
from oddledger.operators.fusion import METHODS, fuse, run_summary
from oddledger.operators.groups import merge_rows, table_stats
from oddledger.operators.quality import extra_copies
from oddledger.schema import REQUIRED_FIELDS

DEFAULT_METHOD = "max"
DEFAULT_THRESHOLD = 0.7

# The preset strategies.
PRESETS = {
    "Basic Statistical Detection": {
        "algorithms": [
            {
                "type": "statistical",
                "name": "zscore",
                "enabled": True,
                "config": {"threshold": 3.0, "window_size": 30},
            }
        ],
        "global_settings": {"aggregation_method": "max", "confidence_threshold": 0.7},
    },
    "Comprehensive Multi-Algorithm": {
        "algorithms": [
            {
                "type": "statistical",
                "name": "zscore",
                "enabled": True,
                "config": {"threshold": 2.5, "window_size": 50},
            },
            {
                "type": "rule_based",
                "name": "weekend_threshold",
                "enabled": True,
                "config": {"weekday_multiplier": 1.0, "weekend_multiplier": 0.3},
            },
            {
                "type": "ml_based",
                "name": "isolation_forest",
                "enabled": True,
                "config": {"contamination": 0.1, "n_estimators": 100},
            },
        ],
        "global_settings": {
            "aggregation_method": "weighted_average",
            "confidence_threshold": 0.6,
            "weights": {"statistical": 0.4, "rule_based": 0.3, "ml_based": 0.3},
        },
    },
    "Rule-Based Only": {
        "algorithms": [
            {
                "type": "rule_based",
                "name": "weekend_threshold",
                "enabled": True,
                "config": {"weekday_multiplier": 1.0, "weekend_multiplier": 0.2},
            },
            {
                "type": "rule_based",
                "name": "periodization",
                "enabled": True,
                "config": {"period_type": "monthly", "threshold_multiplier": 2.0},
            },
        ],
        "global_settings": {"aggregation_method": "max", "confidence_threshold": 0.8},
    },
}
DEFAULT_STRATEGY = PRESETS["Basic Statistical Detection"]


def check_strategy(strategy) -> dict:
    """``{valid, errors, warnings}`` as short codes, without touching any data."""
    found = [*_shape_problems(strategy)]
    return {
        "valid": not any(level == "error" for level, _ in found),
        "errors": [text for level, text in found if level == "error"],
        "warnings": [text for level, text in found if level == "warning"],
    }


def _shape_problems(strategy) -> Iterator[tuple[str, str]]:
    if not isinstance(strategy, dict):
        yield "error", "strategy: not a mapping"
        return
    if "global_settings" in strategy:
        yield from _settings_problems(strategy["global_settings"])
    else:
        yield "warning", "global_settings: defaults"
    specs = strategy.get("algorithms")
    if not isinstance(specs, list) or not specs:
        yield "error", "algorithms: a list with at least one detector"
        return
    for place, spec in enumerate(specs):
        yield from _detector_problems(spec, f"algorithms[{place}]")
    if all(isinstance(s, dict) and not s.get("enabled", True) for s in specs):
        yield "warning", "algorithms: all switched off"


def _detector_problems(spec, place: str) -> Iterator[tuple[str, str]]:
    if not isinstance(spec, dict):
        yield "error", f"{place}: not a mapping"
        return
    absent = {"type", "name", "enabled"} - spec.keys()
    if absent:
        yield "error", f"{place}: without {', '.join(sorted(absent))}"
        return
    if "config" not in spec:
        yield "warning", f"{place}: default configuration"
    try:
        get(spec["type"], spec["name"]).merged(spec.get("config"))
    except (ConfigError, TypeError) as e:
        yield "error", f"{place}: {e}"


def _settings_problems(settings) -> Iterator[tuple[str, str]]:
    if not isinstance(settings, dict):
        yield "error", "global_settings: not a mapping"
        return
    limit = settings.get("confidence_threshold", DEFAULT_THRESHOLD)
    number = isinstance(limit, (int, float)) and not isinstance(limit, bool)
    if not (number and 0 <= limit <= 1):
        yield "error", "confidence_threshold: between 0 and 1"
    method = settings.get("aggregation_method", DEFAULT_METHOD)
    if method not in METHODS:
        yield "error", f"aggregation_method: one of {', '.join(METHODS)}"
    elif method == "weighted_average" and not isinstance(settings.get("weights"), dict):
        given = "weights" in settings
        yield ("error", "weights: not a mapping") if given else ("warning", "weights: none")


def _enabled(strategy: dict) -> list[dict]:
    """Enabled detectors; a repeated one keeps its place and its last settings."""
    specs: dict[tuple[str, str], dict] = {}
    for spec in strategy.get("algorithms", []):
        if spec.get("enabled", True):
            specs[(spec["type"], spec["name"])] = spec
    return list(specs.values())


@dataclass
class StrategyRun:
    """Score table of a run, the detectors in it and those left out."""

    scores: DataFrame
    detectors: list[tuple[str, str]]
    skipped: dict[str, str]


def plan_strategy(data: DataFrame | Transactions, strategy: dict) -> StrategyRun:
    """Build every detector's plan; one that cannot run on the data is skipped."""
    txns = data if isinstance(data, Transactions) else Transactions(data)
    scores, ran, skipped = None, [], {}
    for spec in _enabled(strategy):
        kind, name = spec["type"], spec["name"]
        try:
            found = get(kind, name).run(txns, spec.get("config"))
        except (ConfigError, AnalysisError) as e:
            skipped[f"{kind}.{name}"] = str(e)
            continue
        part = found.select(
            "transaction_id",
            F.lit(kind).alias("algorithm_type"),
            F.lit(name).alias("algorithm_name"),
            F.lit(len(ran)).alias("ordinal"),
            "score",
            "confidence",
            F.to_json("metadata").alias("metadata"),
        )
        scores = part if scores is None else scores.unionByName(part)
        ran.append((kind, name))
    if scores is None:
        raise AnalysisError(f"no detector could run: {skipped}")
    if skipped:
        warnings.warn(f"detectors left out: {skipped}", stacklevel=2)
    return StrategyRun(scores, ran, skipped)


def run_report(run: StrategyRun, spark: SparkSession) -> DataFrame:
    """(detector, ran, reason) of every enabled detector of a run."""
    rows = [(f"{kind}.{name}", True, None) for kind, name in run.detectors]
    rows += [(name, False, reason) for name, reason in run.skipped.items()]
    return spark.createDataFrame(rows, "detector string, ran boolean, reason string")


def run_strategy(data: DataFrame | Transactions, strategy: dict) -> DataFrame:
    """F1: tagged scores of all detectors of the strategy."""
    return plan_strategy(data, strategy).scores


def fuse_strategy(run: StrategyRun, strategy: dict) -> DataFrame:
    settings = strategy.get("global_settings", {})
    return fuse(
        run.scores,
        settings.get("aggregation_method", DEFAULT_METHOD),
        settings.get("confidence_threshold", DEFAULT_THRESHOLD),
        settings.get("weights"),
        run.detectors,
    )


def analyse(data: DataFrame | Transactions, strategy: dict | None = None) -> DataFrame:
    """Run and fuse: one row per scored transaction.

    ``algorithms_skipped`` names the enabled detectors that could not run on the data, with
    the reason; a warning says the same.
    """
    strategy = strategy or DEFAULT_STRATEGY
    run = plan_strategy(data, strategy)
    left_out = [F.lit(f"{name}: {reason}") for name, reason in run.skipped.items()]
    return fuse_strategy(run, strategy).withColumn(
        "algorithms_skipped", F.array(*left_out).cast("array<string>")
    )


def summarise(data: DataFrame | Transactions, strategy: dict | None = None) -> DataFrame:
    """F7 of a run of the strategy, with the detectors that were left out and why."""
    strategy = strategy or DEFAULT_STRATEGY
    run = plan_strategy(data, strategy)
    return run_summary(fuse_strategy(run, strategy), run.skipped)


def data_characteristics(df: DataFrame) -> DataFrame:
    """one row of facts a strategy can be tuned by."""
    rows = df.count()
    nulls = [F.avg(F.col(f"`{c}`").isNotNull().cast("double")) for c in df.columns]
    completeness = nulls[0]
    for share in nulls[1:]:
        completeness = completeness + share
    aggs = {
        "transaction_count": F.count(F.lit(1)),
        "unique_accounts": F.countDistinct("account_id"),
        "date_range_days": F.floor(
            (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp")))
            / 86_400_000_000
        ),
        "amount_mean": F.avg("amount"),
        "amount_std": F.stddev_samp("amount"),
        "amount_min": F.min("amount"),
        "amount_max": F.max("amount"),
        "amount_skewness": sample_skewness("amount"),
        "completeness": completeness / len(df.columns),
        "missing_critical_fields": F.array_compact(
            F.array(*[F.when(F.count_if(F.col(c).isNull()) > 0, F.lit(c)) for c in REQUIRED_FIELDS])
        ),
    }
    if "is_weekend" in df.columns:
        aggs["weekend_ratio"] = F.avg(F.col("is_weekend").cast("double"))
    if "is_business_hours" in df.columns:
        aggs["business_hours_ratio"] = F.avg(F.col("is_business_hours").cast("double"))
    row = merge_rows(
        table_stats(df, aggs, {"amount_median": ("amount", 0.5)}, rows),
        extra_copies(df, df.columns, "duplicate_rows"),
    )
    share = F.try_divide(F.col("amount_std"), F.col("amount_mean"))
    return row.withColumns(
        {
            "outlier_potential": F.coalesce(share, F.lit(0.0)),
            "duplicate_rate": F.coalesce(
                F.try_divide(F.col("duplicate_rows").cast("double"), F.col("transaction_count")),
                F.lit(0.0),
            ),
        }
    ).drop("duplicate_rows")


# How facts about the data change settings.  Where the fact lies below or
# above the limit, the setting is scaled, kept at most, or kept at least.
TUNING = [
    # kind, setting, default, fact, side, limit, change, by
    ("statistical", "threshold", 3.0, "outlier_potential", "below", 0.5, "scale", 0.8),
    ("statistical", "threshold", 3.0, "outlier_potential", "above", 2.0, "scale", 1.2),
    ("statistical", "window_size", 30, "transaction_count", "below", 100, "at most", 10),
    ("statistical", "window_size", 30, "transaction_count", "above", 10_000, "at least", 100),
    ("rule_based", "weekend_multiplier", 0.3, "weekend_ratio", "below", 0.1, "scale", 0.5),
    ("rule_based", "weekend_multiplier", 0.3, "weekend_ratio", "above", 0.3, "scale", 1.5),
    ("ml_based", "contamination", 0.1, "transaction_count", "below", 1000, "at most", 0.05),
    ("ml_based", "n_estimators", 100, "transaction_count", "below", 500, "at most", 50),
    ("ml_based", "n_estimators", 100, "transaction_count", "above", 10_000, "at least", 200),
]
LEAST_COMPLETE, STRICTER, STRICTEST = 0.8, 1.2, 0.9
GLOBAL = -1


def tuning(strategy: dict, facts: DataFrame) -> DataFrame:
    """(place, detector, parameter, old, new) of the settings that the facts change.

    ``facts`` is the row of ``data_characteristics``; ``place`` is the detector's index in
    the strategy, -1 for the global settings.  A fact that is absent changes nothing.
    """
    changes = []

    def change(place: int, detector: str, setting: str, old, applies: Column, new: Column) -> None:
        row = F.struct(
            F.lit(place).alias("place"),
            F.lit(detector).alias("detector"),
            F.lit(setting).alias("parameter"),
            F.lit(float(old)).alias("old"),
            new.cast("double").alias("new"),
        )
        changes.append(F.when(applies, row))

    for place, spec in enumerate(strategy.get("algorithms", [])):
        for kind, setting, default, fact, side, limit, how, by in TUNING:
            if spec.get("type") != kind or fact not in facts.columns:
                continue
            old = spec.get("config", {}).get(setting, default)
            value = F.col(fact)
            applies = value < limit if side == "below" else value > limit
            by, was = F.lit(float(by)), F.lit(float(old))
            new = {"scale": was * by, "at most": F.least(was, by), "at least": F.greatest(was, by)}
            change(place, f"{kind}.{spec.get('name')}", setting, old, applies, new[how])
    old = strategy.get("global_settings", {}).get("confidence_threshold", DEFAULT_THRESHOLD)
    loose = F.col("completeness") < LEAST_COMPLETE
    new = F.least(F.lit(float(old)) * STRICTER, F.lit(STRICTEST))
    change(GLOBAL, "global_settings", "confidence_threshold", old, loose, new)
    return facts.select(F.inline(F.array_compact(F.array(*changes))))


def with_tuning(strategy: dict, changes: DataFrame) -> dict:
    """A copy of the strategy with the changes; they are as few as its settings."""
    tuned = copy.deepcopy(strategy)
    for row in changes.collect():
        if row["place"] == GLOBAL:
            config = tuned.setdefault("global_settings", {})
        else:
            config = tuned["algorithms"][row["place"]].setdefault("config", {})
        whole = row["parameter"] in ("window_size", "n_estimators")
        config[row["parameter"]] = int(row["new"]) if whole else row["new"]
    return tuned


def tune_for(strategy: dict, df: DataFrame) -> dict:
    return with_tuning(strategy, tuning(strategy, data_characteristics(df)))


def compatibility(strategy: dict, df: DataFrame) -> DataFrame:
    """one row per enabled detector: enough rows, usable configuration."""
    spark = df.sparkSession
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    facts = []
    for spec in _enabled(strategy):
        kind, name = spec["type"], spec["name"]
        try:
            detector = get(kind, name)
            detector.merged(spec.get("config"))
            facts.append((kind, name, detector.min_rows, True, None))
        except ConfigError as e:
            facts.append((kind, name, None, False, str(e)))
    schema = "algorithm_type string, algorithm_name string, min_rows long, valid boolean, error string"
    return (
        spark.createDataFrame(facts, schema)
        .withColumn("available_rows", rows)
        .withColumn("min_rows_met", F.col("available_rows") >= F.col("min_rows"))
    )


def sample_by_id(df: DataFrame, size: int) -> DataFrame:
    """A repeatable sample: the rows with the smallest id hashes."""
    if not 10 <= size <= 1000:
        raise ConfigError("sample_size must be between 10 and 1000")
    return df.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(size)


def preview(strategy: dict, df: DataFrame, sample_size: int = 100) -> DataFrame:
    """fused result of a sample (the preview is of a sample by definition)."""
    return analyse(sample_by_id(df, sample_size), strategy)


def compare_strategies(current: dict, proposed: dict, df: DataFrame) -> DataFrame:
    """flagged transactions per day under two strategies."""
    flags = [
        analyse(df, s).filter("is_anomaly").select(F.col("transaction_id").alias("id"), F.lit(1).alias(n))
        for s, n in ((current, "_current"), (proposed, "_proposed"))
    ]
    both = flags[0].join(flags[1], "id", "full_outer")
    days = df.select("id", F.to_date("timestamp").alias("day"))
    return (
        days.join(both, "id")
        .groupBy("day")
        .agg(F.count("_current").alias("current"), F.count("_proposed").alias("proposed"))
    )
