"""Per-detector scores to one score per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.errors import ConfigError

METHODS = ["max", "min", "mean", "weighted_average"]
FOUND_SCORE = 0.5


def detectors_of(scores: DataFrame) -> list[tuple[str, str]]:
    """The detectors of a score table in strategy order (a handful of rows)."""
    rows = (
        scores.groupBy("algorithm_type", "algorithm_name")
        .agg(F.min("ordinal").alias("ordinal"))
        .orderBy("ordinal", "algorithm_type", "algorithm_name")
        .collect()
    )
    return [(r["algorithm_type"], r["algorithm_name"]) for r in rows]


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return total


def fuse(
    scores: DataFrame,
    method: str = "max",
    threshold: float = 0.7,
    weights: dict[str, float] | None = None,
    detectors: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per transaction that at least one detector scored.

    Each detector becomes a pair of columns in one aggregation with plain
    buffers; the fusion itself is arithmetic on that row.
    """
    if method not in METHODS:
        raise ConfigError(f"Invalid aggregation method '{method}'. Must be one of: {METHODS}")
    detectors = detectors_of(scores) if detectors is None else detectors
    aggs, s, c, names = [], [], [], []
    for i, (kind, name) in enumerate(detectors):
        mine = (F.col("algorithm_type") == kind) & (F.col("algorithm_name") == name)
        aggs.append(F.max(F.when(mine, F.col("score").cast("double"))).alias(f"_s{i}"))
        aggs.append(F.max(F.when(mine, F.col("confidence").cast("double"))).alias(f"_c{i}"))
        s.append(F.col(f"_s{i}"))
        c.append(F.col(f"_c{i}"))
        names.append(f"{kind}.{name}")
    wide = scores.groupBy("transaction_id").agg(*aggs)
    used = F.array_compact(
        F.array(*[F.when(x.isNotNull(), F.lit(n)) for x, n in zip(s, names)])
    )
    pairs = F.array_compact(
        F.array(
            *[
                F.when(x.isNotNull(), F.struct(F.lit(n).alias("k"), x.alias("v")))
                for x, n in zip(s, names)
            ]
        )
    )
    wide = wide.withColumn("_n", F.size(used))
    if method in ("max", "min"):
        pick = F.greatest if method == "max" else F.least
        wide = wide.withColumn("final_score", pick(*s) if len(s) > 1 else s[0])
        first = F.coalesce(*[F.when(x == F.col("final_score"), y) for x, y in zip(s, c)])
        wide = wide.withColumn("final_confidence", first)
    elif method == "mean":
        wide = wide.withColumn("final_score", _sum(s) / F.col("_n")).withColumn(
            "final_confidence", _sum(c) / F.col("_n")
        )
    else:
        w = [float((weights or {}).get(kind, 1.0)) for kind, _ in detectors]
        total = _sum([F.when(x.isNotNull(), F.lit(v)) for x, v in zip(s, w)])
        mix = lambda cols: F.coalesce(
            F.when(total > 0, _sum([x * v for x, v in zip(cols, w)]) / F.nullif(total, F.lit(0.0))),
            F.lit(0.0),
        )
        wide = wide.withColumn("final_score", mix(s)).withColumn("final_confidence", mix(c))
    return wide.select(
        "transaction_id",
        "final_score",
        "final_confidence",
        (F.col("final_score") >= float(threshold)).alias("is_anomaly"),
        used.alias("algorithms_used"),
        F.map_from_entries(pairs).alias("individual_scores"),
    )


def run_summary(fused: DataFrame, skipped: dict[str, str] | None = None) -> DataFrame:
    """flagged and all transactions, rate, detectors that gave scores.

    With ``skipped`` the detectors that could not run are listed with the reason.
    """
    summary = fused.agg(
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(
            F.try_divide(F.count_if("is_anomaly").cast("double"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("anomaly_rate"),
        # a set over the handful of detector lists, not over transactions
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("algorithms_used")))).alias(
            "algorithms_executed"
        ),
    )
    if skipped is None:
        return summary
    pairs = [F.lit(text) for item in sorted(skipped.items()) for text in item]
    listed = F.create_map(*pairs).cast("map<string,string>")
    return summary.withColumn("algorithms_skipped", listed)


def detector_log(scores: DataFrame) -> DataFrame:
    """F8: one row per detector."""
    return scores.groupBy("algorithm_type", "algorithm_name").agg(
        F.count(F.lit(1)).alias("transactions_analyzed"),
        F.count_if(F.col("score") > FOUND_SCORE).alias("anomalies_found"),
        F.avg((F.col("score") > FOUND_SCORE).cast("double")).alias("anomaly_rate"),
        F.avg("score").alias("average_score"),
        F.max("score").alias("max_score"),
    )
