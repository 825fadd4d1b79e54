"""Cross-entropy difference: how much better a target model explains a text than a background model.

Both are trigram models over one open vocabulary, every character of all documents, with
the same interpolation: an unseen or rare trigram leans on its bigram, that on its unigram
(Witten-Bell), that on one added count.  The target model counts the target documents, the
background model counts all.  The score is the mean difference of the losses per token.

The models are tables with a row for each trigram that occurs, and grow with the corpus.
Texts are cut into blocks of bounded size; each block gets the losses of its own distinct
trigrams by a join, so no task holds a model.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.llm.arrow import slices
from oddledger.session import staged

# tokens: the edge of a text, characters left out, and characters as their code points from 2 on
EDGE, OTHER, FIRST = 0, 1, 2
BITS = 21
CODES = 0x110000
BLOCK_BYTES = 8 << 20
# distinct trigrams that a task adds up before it hands them on
KEPT_KEYS = 1_000_000


@dataclass(frozen=True)
class Entropy:
    """``symbols`` None: every character is a symbol.

    Else only the commonest are, and two symbols stand for the edge of a text and for all
    rarer characters.
    """

    symbols: int | None = None


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the length of each."""
    full = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(full, "<u4"), np.array([len(t) for t in texts], np.int64)


def _characters(docs: DataFrame) -> DataFrame:
    """(code, n): the characters of all texts, at most as many as there are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                found, times = np.unique(_codes(batch.column(0).to_pylist())[0], return_counts=True)
                total[found] += times
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"]
        )

    counted = docs.filter("text is not null").select("text").mapInArrow(run, "code int, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, p: Entropy) -> list[int]:
    """Code points of the commonest characters of all texts; the smaller code wins a tie."""
    common = _characters(docs).orderBy(F.desc("n"), "code").limit(p.symbols - 2)
    return [r["code"] for r in common.collect()]


def _table(codes: list[int] | None) -> np.ndarray | None:
    """The token of each code point; None where no character is left out."""
    if codes is None:
        return None
    table = np.full(CODES, OTHER, np.int64)
    table[np.array(codes, np.int64)] = np.array(codes, np.int64) + FIRST
    return table


def _trigrams(texts: list[str], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, tokens of each text): a text's tokens are its characters and its end."""
    codes, lengths = _codes(texts)
    full = lengths > 0
    # two edges before each text; the end of one is the first edge of the next
    begin = np.cumsum(lengths[full] + 2) - lengths[full]
    tokens = np.zeros(int((lengths[full] + 2).sum()) + 1, np.int64)
    spots = np.repeat(begin - (np.cumsum(lengths[full]) - lengths[full]), lengths[full])
    tokens[spots + np.arange(len(codes))] = codes.astype(np.int64) + FIRST if table is None else table[codes]
    keys = (tokens[:-2] << (2 * BITS)) | (tokens[1:-1] << BITS) | tokens[2:]
    return keys, np.where(full, lengths + 1, 0)


def _token_keys(texts: list[str], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the predicted tokens only: the second edge before a text is not predicted."""
    keys, counts = _trigrams(texts, table)
    own = np.ones(len(keys), bool)
    ends = np.cumsum(counts[counts > 0] + 1) - 1
    own[ends[ends < len(keys)]] = False
    return keys[own], counts


def _blocks(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, text, target, block): a block holds about ``BLOCK_BYTES`` of text, or one longer text.

    ``targets`` (doc_id) names the target documents, once or several times.  Stored, so a
    row keeps its block.
    """
    marks = targets.filter("doc_id is not null").select("doc_id").distinct()
    marked = (
        docs.select("doc_id", "text")
        # the marks grow with the corpus, so they are shuffled at every size
        .join(marks.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
        .select(F.col("doc_id").cast("long"), "text", F.coalesce("target", F.lit(False)).alias("target"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                size = batch.column(1).nbytes
                if held and held + size > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += size
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(batch.num_rows, block, np.int64))],
                    ["doc_id", "text", "target", "block"],
                )

    return staged(
        marked.mapInArrow(run, "doc_id long, text string, target boolean, block long"), "blocks"
    )


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the counts), one column of counts a model."""
    keys, spot = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros((len(keys), 2), np.int64)
    np.add.at(total, spot, np.concatenate([n for _, n in parts]))
    return keys, total


def trigram_counts(blocks: DataFrame, codes: list[int] | None) -> DataFrame:
    """(block, key, target, background) of each block; ``key`` packs the three tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(codes)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at, held = None, 0

        def put() -> pa.RecordBatch:
            keys, total = _added(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), at, np.int64)),
                    pa.array(keys),
                    pa.array(total[:, 0]),
                    pa.array(total[:, 1]),
                ],
                ["block", "key", "target", "background"],
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                own = batch.column(2).to_numpy(zero_copy_only=False)
                # rows of one block lie together, as they were written
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
                for begin, end in itertools.pairwise(cuts):
                    if parts and (own[begin] != at or held > KEPT_KEYS):
                        yield put()
                        held = 0
                    at = own[begin]
                    part = batch.slice(begin, end - begin)
                    keys, counts = _token_keys(part.column(0).to_pylist(), table)
                    chosen = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), counts)
                    found, spot, times = np.unique(keys, return_inverse=True, return_counts=True)
                    wanted = np.bincount(spot[chosen], minlength=len(found))
                    parts.append((found, np.stack([wanted, times], axis=1)))
                    held += len(found)
        if parts:
            yield put()

    return (
        blocks.filter("text is not null")
        .select("text", "target", "block")
        .mapInArrow(run, "block long, key long, target long, background long")
    )


def losses(counted: DataFrame, size: int) -> DataFrame:
    """(key, loss_target, loss_background): -log p of every trigram that occurs, by both models.

    ``counted`` (key, target, background) has each trigram once; ``size`` is the number of
    symbols.  The background model has seen every trigram of the corpus, so a trigram
    without a row is in no text.
    """
    models = ("target", "background")
    sums = [F.sum(m).alias(m) for m in models]
    low = (1 << BITS) - 1

    def follow(names: str) -> list[Column]:
        """Sum and kinds of what follows a context."""
        total = [F.sum(m).alias(f"{names}_{m}") for m in models]
        return total + [F.sum((F.col(m) > 0).cast("long")).alias(f"{names}_kinds_{m}") for m in models]

    def lean(names: str, m: str, base: str) -> Column:
        total, kinds = F.col(f"{names}_{m}"), F.col(f"{names}_kinds_{m}")
        mixed = (F.col(m) + kinds * F.col(f"{base}_{m}")) / (total + kinds)
        return F.when(total > 0, mixed).otherwise(F.col(f"{base}_{m}"))

    three = counted.withColumns(
        {"ab": F.shiftright("key", BITS), "bc": F.col("key").bitwiseAND((1 << 2 * BITS) - 1)}
    )
    two = staged(three.groupBy("bc").agg(*sums), "bigrams").withColumns(
        {"b": F.shiftright("bc", BITS), "c": F.col("bc").bitwiseAND(low)}
    )
    one = two.groupBy("c").agg(*sums)
    total = two.agg(*sums).first()
    p1 = one.select(
        "c", *[((F.col(m) + 1) / ((total[m] or 0) + size)).alias(f"p1_{m}") for m in models]
    )
    p2 = (
        two.join(two.groupBy("b").agg(*follow("b")), "b")
        .join(p1, "c")
        .select("bc", *[lean("b", m, "p1").alias(f"p2_{m}") for m in models])
    )
    return (
        three.join(three.groupBy("ab").agg(*follow("ab")), "ab")
        .join(p2, "bc")
        .select("key", *[(-F.log(lean("ab", m, "p2"))).alias(f"loss_{m}") for m in models])
    )


def score(docs: DataFrame, targets: DataFrame, p: Entropy | None = None) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of every row of ``docs``.

    Losses are nats per token; the lower the score, the closer to the target documents.
    Null and empty texts have no tokens and zeros.  Without target documents the target
    model is uniform.
    """
    p = p or Entropy()
    blocks = _blocks(docs, targets)
    codes = None if p.symbols is None else vocabulary(blocks, p)
    size = (_characters(blocks).count() if codes is None else len(codes)) + FIRST
    # a block may have been counted in several parts
    counted = staged(trigram_counts(blocks, codes), "trigrams")
    whole = staged(
        counted.groupBy("key").agg(*[F.sum(m).alias(m) for m in ("target", "background")]), "models"
    )
    wanted = counted.select("block", "key").distinct().join(losses(whole, size), "key")

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        loss = [known.column(f"loss_{m}").to_numpy()[order] for m in ("target", "background")]
        table = _table(codes)
        out = []
        for whole in texts.combine_chunks().to_batches():
            for batch in slices(whole, "text"):
                own = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                found, counts = _token_keys(own, table)
                spots = np.searchsorted(keys, found)
                means = []
                starts = (np.cumsum(counts) - counts)[counts > 0]
                for table_loss in loss:
                    mean = np.zeros(len(own))
                    if len(starts):
                        mean[counts > 0] = np.add.reduceat(table_loss[spots], starts)
                    means.append(mean / np.maximum(counts, 1))
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            batch.column(batch.schema.get_field_index("doc_id")),
                            pa.array(counts),
                            *(pa.array(m) for m in means),
                            pa.array(means[0] - means[1]),
                        ],
                        ["doc_id", "n_tokens", "loss_target", "loss_background", "score"],
                    )
                )
        return pa.Table.from_batches(out, schema=SCORED)

    return (
        blocks.select("block", "doc_id", "text")
        .groupBy("block")
        .cogroup(wanted.groupBy("block"))
        .applyInArrow(
            run,
            "doc_id long, n_tokens long, loss_target double, loss_background double, score double",
        )
    )


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    + [(c, pa.float64()) for c in ("loss_target", "loss_background", "score")]
)
