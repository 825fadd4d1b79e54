"""Z-score of the amount against rolling or whole-history statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.operators.detectors.base import Detector, Transactions, register, require, scored
from oddledger.operators.groups import global_ordered_columns, grouped_columns, one_row

ORDER = ["timestamp", "id"]


def _rolling(window_size: int) -> dict:
    """Statistics of the up to ``window_size - 1`` rows before the current one."""
    prior = lambda w: w.rowsBetween(-(window_size - 1), -1)
    return {
        "_roll_n": lambda w: F.count("amount").over(prior(w)),
        "_roll_mean": lambda w: F.avg("amount").over(prior(w)),
        "_roll_std": lambda w: F.stddev_samp("amount").over(prior(w)),
    }


def _zscore(mean: Column, std: Column) -> Column:
    """0 where the spread is unknown or zero."""
    return F.when(std > 0, (F.col("amount") - mean) / std).otherwise(0.0)


class ZScoreDetector(Detector):
    type = "statistical"
    name = "zscore"
    description = "Distance of an amount from its usual level in standard deviations"
    min_rows = 2
    default_config = {
        "threshold": 3.0,
        "window_size": 30,
        "min_transactions": 5,
        "use_rolling_window": True,
        "account_specific": True,
        "absolute_zscore": True,
    }

    def validate(self, config: dict) -> None:
        require(config["threshold"] > 0, "threshold must be positive")
        require(config["window_size"] >= 2, "window_size must be at least 2")
        require(config["min_transactions"] >= 1, "min_transactions must be at least 1")

    def detect(self, txns: Transactions, config: dict) -> DataFrame:
        if config["account_specific"]:
            return self._per_account(txns, config)
        return self._over_all(txns, config)

    def _result(self, df: DataFrame, config: dict, z: Column, metadata: dict) -> DataFrame:
        score = F.abs(z) if config["absolute_zscore"] else z
        sure = F.least(F.lit(1.0), F.abs(z) / float(config["threshold"]))
        return scored(df, score, sure, metadata)

    def _per_account(self, txns: Transactions, config: dict) -> DataFrame:
        size = config["window_size"]
        df = grouped_columns(
            txns.split(ordered=True),
            "account_id",
            ORDER,
            ordered=_rolling(size) if config["use_rolling_window"] else None,
            before=size - 1,
            aggregates={
                "_n": F.count("amount"),
                "_mean": F.avg("amount"),
                "_std": F.stddev_samp("amount"),
            },
        )
        whole = {
            "mean_amount": F.col("_mean"),
            "std_amount": F.col("_std"),
            "window_size_used": F.lit(None).cast("long"),
            "total_transactions": F.col("_n"),
        }
        z = _zscore(F.col("_mean"), F.col("_std"))
        metadata = whole
        keep = F.col("_n") >= max(config["min_transactions"], 2)
        if config["use_rolling_window"]:
            rolls = F.col("_n") >= size
            keep = (F.col("_n") >= config["min_transactions"]) & (rolls | (F.col("_n") >= 2))
            z = F.when(rolls, _zscore(F.col("_roll_mean"), F.col("_roll_std"))).otherwise(z)
            part = {
                "mean_amount": F.col("_roll_mean"),
                "std_amount": F.col("_roll_std"),
                "window_size_used": F.col("_roll_n") + 1,
                "total_transactions": F.lit(None).cast("long"),
            }
            metadata = {k: F.when(rolls, part[k]).otherwise(whole[k]) for k in whole}
        metadata["account_id"] = F.col("account_id")
        metadata["global_calculation"] = F.lit(False)
        return self._result(df.filter(keep), config, z, metadata)

    def _over_all(self, txns: Transactions, config: dict) -> DataFrame:
        slim = txns.df.select("id", "account_id", "timestamp", "amount")
        size = config["window_size"]
        shared = {"account_id": F.col("account_id"), "global_calculation": F.lit(True)}
        if config["use_rolling_window"] and txns.rows >= size:
            df = global_ordered_columns(slim, ORDER, _rolling(size), before=size - 1)
            metadata = {
                "mean_amount": F.col("_roll_mean"),
                "std_amount": F.col("_roll_std"),
                "window_size_used": F.col("_roll_n") + 1,
                "total_transactions": F.lit(None).cast("long"),
                **shared,
            }
            z = _zscore(F.col("_roll_mean"), F.col("_roll_std"))
            return self._result(df, config, z, metadata)
        stats = one_row(
            slim.agg(
                F.count("amount").alias("n"),
                F.avg("amount").alias("mean"),
                F.stddev_samp("amount").alias("std"),
            )
        )
        df = slim.withColumn("_s", stats)
        metadata = {
            "mean_amount": F.col("_s.mean"),
            "std_amount": F.col("_s.std"),
            "window_size_used": F.lit(None).cast("long"),
            "total_transactions": F.col("_s.n"),
            **shared,
        }
        return self._result(df, config, _zscore(F.col("_s.mean"), F.col("_s.std")), metadata)


register(ZScoreDetector())
