"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The pieces are those of a model file; their log-probabilities are estimated here over all
texts, as the file has merge ranks in their place: first from the file's own segmentation of
every unit, a run of blanks and what follows, then from the best segmentation under the
estimate before.  An Aho-Corasick automaton lists the pieces that end at each character.  For every prefix
of a word the search carries the best score and the number of pieces on that path, not
the path.  Of equal scores the one whose last piece begins first stays; a character
without a piece of its own costs ten below the lowest score and counts its UTF-8 bytes.
"""

from __future__ import annotations

import collections
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddledger.llm.arrow import slices
from oddledger.llm.pieces import MODEL
from oddledger.session import shuffle_partitions, staged

SPACE = "▁"
PENALTY = 10.0
KEPT_WORDS = 500_000
UNIT = re.compile(" +[^ ]*")
# what a piece counts that no text has
UNSEEN = 0.1
# the most frequent units, whose tokens are counted once for all tasks
FREQUENT = 200_000

Vocabulary = list[tuple[str, float]]


def load(path: str = MODEL) -> Vocabulary:
    """Pieces and scores of a model file, by id; id 0 is the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]


def units(text: str) -> list[str]:
    """A text with its leading space mark, cut before every run of blanks."""
    return UNIT.findall(" " + text.replace(SPACE, " ")) if text else []


class Counter:
    """Counts tokens; units met before are looked up, and the table is emptied when full."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT_WORDS, frequent: dict[str, int] | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.unknown = vocabulary[0][0]
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score, piece == self.unknown))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1 and piece != self.unknown}
        self.lowest = min(score for _, score in vocabulary) - PENALTY
        self.kept = kept
        self.frequent = frequent or {}
        self.seen: dict[str, int] = dict(self.frequent)

    def _known(self, word: str) -> tuple[list[float], list[int], list[int]] | None:
        """(scores, piece counts, starts of the last pieces) where every character is a piece.

        The automaton names the longest piece first, so the piece that begins first wins a tie.
        """
        if self.unknown in word or not self.single.issuperset(word):
            return None
        n = len(word) + 1
        score, pieces, back = [-math.inf] * n, [0] * n, [0] * n
        score[0] = 0.0
        for end, (length, own, _) in self.automaton.iter(word):
            end += 1
            start = end - length
            total = score[start] + own
            if total > score[end]:
                score[end], pieces[end], back[end] = total, pieces[start] + 1, start
        return score, pieces, back

    def pieces(self, word: str) -> list[str]:
        """The pieces on the best path, from the last on.

        A word with a character that is no piece stands for its known parts.
        """
        found = self._known(word)
        if found is None:
            return [p for part in self._parts(word) for p in self.pieces(part)]
        out, at = [], len(word)
        while at:
            out.append(word[found[2][at] : at])
            at = found[2][at]
        return out

    def _parts(self, word: str) -> list[str]:
        """Runs of characters that are pieces."""
        return [
            "".join(run)
            for known, run in itertools.groupby(word, lambda c: c in self.automaton and c != self.unknown)
            if known and "".join(run) != word
        ]

    def word(self, word: str) -> int:
        """Tokens of one word, its leading space mark included."""
        if self.unknown in word or not self.single.issuperset(word):
            return self._with_unknown(word)
        # as in _known, without the way back
        n = len(word) + 1
        score, pieces = [-math.inf] * n, [0] * n
        score[0] = 0.0
        for end, (length, own, _) in self.automaton.iter(word):
            end += 1
            total = score[end - length] + own
            if total > score[end]:
                score[end] = total
                pieces[end] = pieces[end - length] + 1
        return pieces[-1]

    def _with_unknown(self, word: str) -> int:
        """The same where a character has no piece of its own."""
        n = len(word)
        ends: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        score = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        # bytes of the unknown run that ends here and whether it is one literal unknown piece
        run: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        for end in range(n):
            best, single = None, False
            # longest first: the piece that begins first wins a tie
            for length, own, literal in sorted(ends[end], reverse=True, key=lambda m: m[0]):
                single |= length == 1
                start = end + 1 - length
                total = score[start] + own
                if best is None or total > best[0]:
                    best = (total, start, literal, True)
            if not single and (best is None or score[end] + self.lowest > best[0]):
                best = (score[end] + self.lowest, end, True, False)
            total, start, unknown, piece = best
            score[end + 1] = total
            if not unknown:
                pieces[end + 1] = pieces[start] + 1
                continue
            # neighbouring unknown parts are one string, which falls back to its bytes
            before, alone = run[start]
            size = len(word[start : end + 1].encode("utf-8", "surrogatepass"))
            if piece and not before:
                pieces[end + 1], run[end + 1] = pieces[start] + 1, (size, True)
            else:
                extra = before - 1 if alone else 0
                pieces[end + 1], run[end + 1] = pieces[start] + extra + size, (before + size, False)
        return pieces[n]

    def text(self, text: str) -> int:
        """Tokens of a whole text; no piece reaches across the beginning of a unit."""
        total, seen = 0, self.seen
        for unit in units(text):
            n = seen.get(unit)
            if n is None:
                if len(seen) >= self.kept + len(self.frequent):
                    seen.clear()
                    seen.update(self.frequent)
                n = seen[unit] = self.word(unit.replace(" ", SPACE))
            total += n
        return total


def unit_counts(docs: DataFrame, kept: int = KEPT_WORDS) -> DataFrame:
    """(unit, n): how often each unit stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: collections.Counter[str] = collections.Counter()

        def put() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["unit", "n"]
            )
            held.clear()
            return part

        for whole in batches:
            for batch in slices(whole, "text"):
                for text in batch.column(0).to_pylist():
                    held.update(units(text or ""))
                if len(held) > kept:
                    yield put()
        yield put()

    found = docs.select("text").mapInArrow(run, "unit string, n long")
    return found.groupBy("unit").agg(F.sum("n").alias("n"))


def _piece_counts(counted: DataFrame, cut: Callable[[], Callable[[list[str]], list[list[int]]]], size: int) -> np.ndarray:
    """How often each piece stands in the segmentations; the driver gets one number a piece.

    ``cut`` makes what gives the piece ids of units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = cut()
        total = np.zeros(size)
        for batch in batches:
            found = ids_of(batch.column(0).to_pylist())
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(lengths.sum()))
            total += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), lengths), size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen].astype(np.int64))], ["id", "n"])

    found = counted.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size)
    for r in found.collect():
        out[r["id"]] = r["n"]
    return out


def _log_probabilities(total: np.ndarray) -> list[float]:
    return np.log((total + UNSEEN) / (total.sum() + UNSEEN * len(total))).tolist()


def stored_units(docs: DataFrame) -> DataFrame:
    return staged(unit_counts(docs), "units").repartition(shuffle_partitions(docs.sparkSession), "unit")


def frequent_units(counted: DataFrame, vocabulary: Vocabulary, most: int = FREQUENT) -> dict[str, int]:
    """The tokens of the units that stand in the texts most often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            tokens = [counter.word(unit.replace(" ", SPACE)) for unit in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], ["unit", "tokens"])

    top = counted.orderBy(F.desc("n"), "unit").limit(most).select("unit")
    found = top.repartition(shuffle_partitions(top.sparkSession)).mapInArrow(run, "unit string, tokens long")
    return {r["unit"]: r["tokens"] for r in found.collect()}


def learn(docs: DataFrame, path: str = MODEL, rounds: int = 1, counted: DataFrame | None = None) -> Vocabulary:
    """The pieces of the file with log-probabilities from all texts of ``docs``.

    ``rounds`` estimates follow the first one, each from the best segmentations under the one
    before.  Without any text all pieces are as likely.
    """
    known = [piece for piece, _ in load(path)]
    counted = stored_units(docs) if counted is None else counted

    def merged() -> Callable[[list[str]], list[list[int]]]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda part: sp.encode([unit[1:] for unit in part], num_threads=1)

    scores = _log_probabilities(_piece_counts(counted, merged, len(known)))
    for _ in range(rounds):
        vocabulary = list(zip(known, scores, strict=True))

        def best(vocabulary: Vocabulary = vocabulary) -> Callable[[list[str]], list[list[int]]]:
            counter, spot = Counter(vocabulary), {piece: i for i, (piece, _) in enumerate(vocabulary)}
            return lambda part: [
                [spot[piece] for piece in counter.pieces(unit.replace(" ", SPACE))] for unit in part
            ]

        scores = _log_probabilities(_piece_counts(counted, best, len(known)))
    return list(zip(known, scores, strict=True))


def count_tokens(docs: DataFrame, path: str = MODEL, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row; a null or empty text has none.

    Without ``vocabulary`` the pieces of the file get their scores from ``docs``.
    """
    frequent: dict[str, int] = {}
    if not vocabulary:
        counted = stored_units(docs)
        vocabulary = learn(docs, path, counted=counted)
        frequent = frequent_units(counted, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, frequent = shared.value
        counter = Counter(pieces, frequent=frequent)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.array([len(t) for t in texts], np.int64)),
                        pa.array(np.array([counter.text(t) for t in texts], np.int64)),
                    ],
                    ["doc_id", "n_chars", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long"
    )
