"""Language identification by a bidirectional recurrent network over bytes.

Every byte position of the whole text gets label probabilities; the document's are the
mean over the positions of letters.  The network reads windows of ``steps`` bytes, one
after another, with fresh states in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from oddledger.llm import bigru
from oddledger.llm.arrow import append, utf8_column
from oddledger.llm.sampling import counted, held_out, labelled_sample

UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class LanguageModel:
    """``documents`` per label and ``windows`` of each bound the training sample."""

    hidden: int = 6
    steps: int = 64
    documents: int = 300
    windows: int = 6
    epochs: int = 8
    batch: int = 2048


def _training_windows(docs: DataFrame, p: LanguageModel) -> pd.DataFrame:
    """Windows of the sampled documents, at offsets drawn from the doc_id; bounded by ``p``."""
    ids = labelled_sample(docs.select("doc_id", "lang"), "lang", p.documents).select("doc_id")
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, lang, text in frame.itertuples(index=False):
                data = text.encode()
                draw = np.random.default_rng(doc_id & 0x7FFFFFFF)
                for k, at in enumerate(draw.integers(0, max(1, len(data) - p.steps + 1), p.windows)):
                    out.append((doc_id, k, lang, data[at : at + p.steps]))
                    if len(data) <= p.steps:
                        break
            yield pd.DataFrame(out, columns=["doc_id", "k", "lang", "piece"])

    picked = rows.join(counted(ids.distinct()), "doc_id", "left_semi").mapInPandas(
        cut, "doc_id long, k int, lang string, piece binary"
    )
    return picked.toPandas().sort_values(["doc_id", "k", "piece"], ignore_index=True)


def fit(docs: DataFrame, p: LanguageModel | None = None) -> tuple[list[str], bigru.Params | None]:
    """(labels, network) learned from text and lang of documents that are not held out."""
    p = p or LanguageModel()
    sample = _training_windows(docs, p)
    labels = sorted(sample["lang"].unique())
    if not labels:
        return [], None
    x = np.zeros((len(sample), p.steps), np.uint8)
    for row, piece in zip(x, sample["piece"], strict=True):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    y = np.searchsorted(np.array(labels, object), sample["lang"].to_numpy(object))
    weight = _LETTER[x].T.astype(np.float32)
    net = bigru.train(x.T.astype(np.intp), y, weight, len(labels), p.hidden, p.epochs)
    return labels, net


def document_probabilities(
    net: bigru.Params, data: np.ndarray, at: np.ndarray, p: LanguageModel
) -> np.ndarray:
    """(labels, texts): mean over the letter positions of each text, 0 where there are none."""
    sizes = np.diff(at)
    per_doc = -(-sizes // p.steps)
    doc = np.repeat(np.arange(len(sizes)), per_doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    begin = at[:-1][doc] + nth * p.steps
    end = np.minimum(begin + p.steps, at[1:][doc])
    padded = np.concatenate([data, np.zeros(p.steps, np.uint8)])
    total = np.zeros((len(net["c"]), len(sizes)))
    letters = np.zeros(len(sizes))
    along = np.arange(p.steps)[:, None]
    for low in range(0, len(doc), p.batch):
        part = slice(low, low + p.batch)
        x = padded[begin[part] + along]
        x[along >= (end - begin)[part]] = 0
        seen = _LETTER[x]
        probs = bigru.probabilities(net, x.astype(np.intp))
        pooled = np.einsum("lsb,sb->lb", probs, seen.astype(np.float32))
        letters += np.bincount(doc[part], seen.sum(axis=0), len(sizes))
        for label, row in enumerate(pooled):
            total[label] += np.bincount(doc[part], row, len(sizes))
    return total / np.maximum(letters, 1)


def with_language(
    rows: DataFrame,
    labels: list[str],
    net: bigru.Params | None,
    p: LanguageModel | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
    omit: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` (text, further columns) with the predicted label and its score.

    A null text, an empty one and one without letters is ``und`` with score 0, and so is
    everything where no labelled row was there to learn from.  Ties go to the first label.
    """
    p = p or LanguageModel()
    label, score = names
    if net is None:
        return rows.withColumns({label: F.lit(UNKNOWN), score: F.lit(0.0)}).drop(*omit)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    marker = "_letters"
    while marker in rows.columns:
        marker += "_"

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        probs = document_probabilities(net, *utf8_column(batch.column("text")), p)
        known = batch.column(marker).to_numpy(zero_copy_only=False)
        best = probs.argmax(axis=0)
        name = [labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return [pa.array(name, pa.string()), pa.array(np.where(known, probs.max(axis=0), 0.0))]

    return append(
        rows.withColumn(marker, letters),
        compute,
        {label: StringType(), score: DoubleType()},
        (marker, *omit),
    )


def identify(docs: DataFrame, p: LanguageModel | None = None) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict all of them from their texts alone:
    (doc_id, held_out, lang_pred, score)."""
    labels, net = fit(docs, p)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return with_language(rows, labels, net, p, omit=("text",))
