"""Importance resampling towards a target distribution.

Runs of words are hashed to buckets.  What the target holds in a bucket against what all
documents hold gives the bucket's gain; the sum of a document's gains is the log of its
importance.  With a fixed Gumbel noise for each document, the highest scores are a sample
without replacement that follows the target.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from oddledger.llm.arrow import append, slices, utf8_column
from oddledger.llm.intern import Table, intern
from oddledger.operators.groups import position_rows
from oddledger.session import staged

# bytes of words, A-Z in lower case
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to ``runs`` words; ``percent`` of the documents with ``words`` words are drawn."""

    runs: int = 1
    buckets: int = 10_000
    scale: int = 1000
    words: int = 20
    percent: int = 10
    seed: int = 2024


def features(data: np.ndarray, at: np.ndarray, runs: int):
    """(bytes, starts, lengths, text of each feature, words of each text).

    A feature is a run of 1 to ``runs`` words of one text ``data[at[i]:at[i + 1]]``, joined by
    one space.
    """
    low = _BYTE[data]
    inside = _WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    begins[inner] = inside[inner]
    first = np.searchsorted(np.flatnonzero(begins), at)
    # every word once more, with one space behind it
    number = np.cumsum(begins)[inside] - 1
    spots = np.arange(len(number)) + number
    words = int(first[-1])
    joined = np.full(len(number) + words + 8, 0x20, np.uint8)
    joined[spots] = low[inside]
    size = np.bincount(number, minlength=words)
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    last = first[1:][text]
    starts, lengths, texts = [], [], []
    for k in range(1, runs + 1):
        head = np.flatnonzero(np.arange(words) + k <= last)
        starts.append(begin[head])
        lengths.append(end[head + k - 1] - begin[head])
        texts.append(text[head])
    return joined, np.concatenate(starts), np.concatenate(lengths), np.concatenate(texts), np.diff(first)


def _interned(column: pa.Array, p: Resampling) -> tuple[Table, np.ndarray, np.ndarray]:
    joined, starts, lengths, texts, words = features(*utf8_column(column), p.runs)
    table = intern(joined, starts, lengths, lambda run: zlib.crc32(run) % p.buckets)
    return table, texts, words


def bucket_counts(docs: DataFrame, p: Resampling) -> np.ndarray:
    """Features of all texts in each bucket; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                table, _, _ = _interned(batch.column(0), p)
                np.add.at(total, table.bucket, table.count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(p.buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(all_: np.ndarray, target: np.ndarray, p: Resampling) -> np.ndarray:
    """Gain of each bucket from its features in all documents and in the target."""
    s, t = float(all_.sum()), float(target.sum())
    return np.array(
        [
            math.floor(p.scale * math.log((b + 1.0) * (s + p.buckets) / ((a + 1.0) * (t + p.buckets))))
            for a, b in zip(all_.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, p: Resampling) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row of ``docs`` (doc_id, text)."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        table, texts, words = _interned(batch.column(batch.schema.get_field_index("text")), p)
        weight = np.zeros(batch.num_rows, np.int64)
        np.add.at(weight, texts, gain[table.bucket][table.slots])
        counts = np.bincount(texts, minlength=batch.num_rows)
        return [pa.array(counts.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(weight)]

    added = {"n_features": LongType(), "n_words": LongType(), "weight": LongType()}
    return append(docs.select("doc_id", "text"), compute, added, omit=("text",))


def resample(docs: DataFrame, target: DataFrame, p: Resampling | None = None) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``target`` (text) is the distribution to follow.  Documents with enough words are ranked by
    score, ties by the smaller doc_id, null last, then by fewer features; ``percent`` of them
    are drawn and carry their rank, all others null.  Null and empty texts have no features and
    weight 0.  A null doc_id draws its noise as an empty one.  Rows with one doc_id have the same
    noise and are ranked each.  Other columns are left aside.
    """
    p = p or Resampling()
    gain = gains(bucket_counts(docs, p), bucket_counts(target, p), p)
    name = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-p.scale * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(
        weighted(docs, gain, p).withColumn("score", (F.col("weight") + noise).cast("long")), "scores"
    )
    enough = F.col("n_words") >= p.words
    able = scored.filter(enough)
    drawn = p.percent * able.count() // 100
    ordered = able.select(
        "*", F.lit(1).alias("_one"), (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_last")
    )
    order = ["_down", "_last", "doc_id", "n_features"]
    ranked = position_rows(ordered, ["_one"], order, "rank").select(*scored.columns, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
