"""Quality of documents by gradient-boosted trees over statistics of their whole texts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from oddledger.llm.arrow import append, list_column, utf8_column
from oddledger.llm.boosting import Boosting, Model, train
from oddledger.llm.hashing import words
from oddledger.llm.sampling import counted, held_out, labelled_sample

CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (9, 11, 12, 13, 32),
    "line": (10,),
    "stop": (33, 46, 63),
    "comma": (44, 58, 59),
    "quote": (34, 39, 40, 41, 45),
    "sign": (35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126),
    "bar": (124,),
    "high": range(128, 256),
}
FEATURES = [
    *CLASSES, "bytes", "words", "word_size", "distinct", "repeat", "top", "lines", "line_copies",
    "sentence", "entropy", "capitals", "shout", "line_size",
]
_CLASS = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members), _i] = 1.0


@dataclass(frozen=True)
class QualityModel:
    """``rows`` per label bound the training sample; a score from ``bar`` on is label 1."""

    rows: int = 4000
    bar: float = 0.7
    boosting: Boosting = field(default_factory=Boosting)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text is all zeros."""
    hashes, first = words(data, at)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    for row, (a, b, u, v) in enumerate(zip(at[:-1], at[1:], first[:-1], first[1:], strict=True)):
        if b == a:
            continue
        piece, own = data[a:b], hashes[u:v]
        counts = np.bincount(piece, minlength=256)
        share = counts / (b - a)
        live = share[share > 0]
        kinds = share @ _CLASS
        n = max(v - u, 1)
        _, times = np.unique(own, return_counts=True)
        lines = piece.tobytes().split(b"\n")
        full = [line for line in lines if line.strip()]
        letters = counts[97:123].sum() + counts[65:91].sum()
        stops = counts[[33, 46, 63]].sum()
        out[row] = [
            *kinds,
            np.log1p(b - a),
            np.log1p(v - u),
            (b - a - counts[[9, 10, 11, 12, 13, 32]].sum()) / n,
            len(times) / n,
            (own[1:] == own[:-1]).sum() / n,
            times.max(initial=0) / n,
            np.log1p(len(full)),
            1.0 - len(set(full)) / max(len(full), 1),
            n / (stops + 1.0),
            -(live * np.log2(live)).sum(),
            counts[65:91].sum() / max(letters, 1),
            counts[33] / n,
            n / max(len(full), 1),
        ]
    return out


def _statistics_column(batch: pa.RecordBatch) -> list[pa.Array]:
    x = statistics(*utf8_column(batch.column("text")))
    width = np.full(len(x), len(FEATURES))
    return [list_column(x.ravel(), width, pa.float64())]


def fit(docs: DataFrame, labels: DataFrame, p: QualityModel | None = None) -> Model:
    """Learn from ``labels`` (doc_id, quality) of documents that are not held out.

    Null labels count for nothing; a document with several labels gives a row for each.
    """
    p = p or QualityModel()
    # a label without its document must not use up the sample
    known = labels.select("doc_id", "quality").join(
        docs.select("doc_id").distinct(), "doc_id", "left_semi"
    )
    sample = counted(labelled_sample(known, "quality", p.rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    # at most ``rows`` of each label
    found = append(rows, _statistics_column, {"x": ArrayType(DoubleType())}, ("text",)).toPandas()
    found["x"] = found["x"].map(tuple)
    found = found.sort_values(["doc_id", "quality", "x"])
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, (found["quality"].to_numpy() == 1).astype(float), p.boosting)


def with_quality(
    rows: DataFrame,
    model: Model,
    p: QualityModel | None = None,
    names: tuple[str, str] = ("score", "predicted"),
    omit: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` (text, further columns) with score and prediction; a null text is empty."""
    p = p or QualityModel()

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        score = model.score(statistics(*utf8_column(batch.column("text"))))
        return [pa.array(score), pa.array((score >= p.bar).astype(np.int32))]

    score, predicted = names
    return append(rows, compute, {score: DoubleType(), predicted: IntegerType()}, omit)


def classify(docs: DataFrame, labels: DataFrame, p: QualityModel | None = None) -> DataFrame:
    """Learn from the labelled rows and score all of ``docs`` from their texts alone:
    (doc_id, held_out, score, predicted)."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return with_quality(rows, fit(docs, labels, p), p, omit=("text",))
