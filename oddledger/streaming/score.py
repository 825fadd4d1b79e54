"""Scores for arriving transactions from a stored forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from oddledger.operators.detectors import get


def score_stream(model: DataFrame, stream: DataFrame) -> DataFrame:
    """ST2: stateless; the score range is that of the training rows.

    The forest travels to the executors; one too large for that is refused here and scored
    by ``start_scoring``.
    """
    return get("ml_based", "isolation_forest").score(model, stream)


def start_scoring(model: DataFrame, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ST2 for a forest of any size: every micro-batch meets the parts of the forest.

    A batch that is run again after a failure replaces its own folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        scores = get("ml_based", "isolation_forest").score(model, batch)
        scores.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
