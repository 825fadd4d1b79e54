"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddledger.session import staged

BROADCAST_ROWS = 100_000


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """Up to ``per_label`` rows of each label, those with the smallest hash of doc_id.

    ``rows`` has doc_id and the label only.  A bound on the hash, from the counts of the
    labels, leaves little more than the rows wanted; it is raised where it left too few, as
    repeated ids may have it, so no task gets all rows of a label.
    """
    known = rows.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # one number for each label that is learned
    counts = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {value: min(n, per_label) for value, n in counts.items()}
    shares = {value: (per_label + 10 * per_label**0.5 + 100) / n for value, n in counts.items()}
    hashed = known.withColumn("_hash", F.xxhash64("doc_id"))
    while True:
        bounds = [
            F.when(F.col(label) == value, F.lit(-(1 << 63) + int(share * (1 << 64))))
            for value, share in shares.items()
            if share < 1
        ]
        near = hashed.filter(F.col("_hash") <= F.coalesce(*bounds, F.lit((1 << 63) - 1)))
        found = {r[label]: r["n"] for r in near.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [value for value, n in wanted.items() if found.get(value, 0) < n]
        if not short:
            break
        for value in short:
            shares[value] *= 8
    order = Window.partitionBy(label).orderBy("_hash", "doc_id")
    return (
        near.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= per_label)
        .drop("_rank", "_hash")
    )


def counted(rows: DataFrame) -> DataFrame:
    """Store ``rows`` and mark them for broadcast when there are at most ``BROADCAST_ROWS``."""
    stored = staged(rows, "sample")
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored
