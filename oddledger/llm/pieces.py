"""SentencePiece encoding with seeded merge-dropout, and its decoding.

The agenda of a merge-type model takes the best-scored merge first, the leftmost of
equals.  Each candidate merge is skipped when a hash of (seed, doc_id, its three
borders in the text) falls below ``dropout``: a seed gives each document one varied
segmentation, and the same one again on any cluster.  No piece has a space after
another character, so a text falls into chunks that never merge with each other; the
agendas of all short chunks of a batch run side by side in numpy, one merge a round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddledger.llm.arrow import list_column, slices
from oddledger.llm.hashing import mix, stream

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
NEVER = np.int32(2**31 - 1)
LONG = 48
_PLACE = stream(31, 4) | np.uint64(1)


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model file; its size follows the vocabulary alone.

    Symbols are the pieces by id, then the characters that occur in pieces only.
    """

    size: int
    text: list[bytes]
    chars: dict[int, int]
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    bytes_at: np.ndarray
    extra: list[int]


def load(path: str = MODEL) -> Pieces:
    """Read a merge-type model with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    plain = [
        i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
    ]
    symbols = {pieces[i]: i for i in plain}
    wide = [i for i in plain if len(pieces[i]) > 1]
    if any(chr(SPACE) in pieces[i].lstrip(chr(SPACE)) for i in wide):
        raise ValueError(f"{path}: a piece has a space after another character")
    extra = sorted({c for i in wide for c in pieces[i]} - symbols.keys())
    symbols |= {c: size + k for k, c in enumerate(extra)}
    score = {i: sp.get_score(i) for i in wide}
    ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    rows = [
        (symbols[a], symbols[b], i, ranks[score[i]])
        for i in wide
        for cut in range(1, len(pieces[i]))
        if (a := pieces[i][:cut]) in symbols and (b := pieces[i][cut:]) in symbols
    ]
    table = np.array(rows, np.int64).reshape(-1, 4)
    byte_ids = {pieces[i]: i for i in range(size) if sp.is_byte(i)}
    text = [
        b"" if sp.is_control(i) or sp.is_unknown(i)
        else bytes([int(p[3:5], 16)]) if sp.is_byte(i)
        else p.replace(chr(SPACE), " ").encode()
        for i, p in enumerate(pieces)
    ]
    return Pieces(
        size,
        text,
        {ord(c): i for c, i in symbols.items() if len(c) == 1},
        *table.T,
        np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.int32),
        [ord(c) for c in extra],
    )


class Encoder:
    """Tables for one model and one dropout; made once in each task."""

    BITS = 20

    def __init__(self, p: Pieces, dropout: float, seed: int):
        self.p, self.seed = p, seed
        self.limit = np.uint64(min(max(dropout, 0.0), 1.0) * 2.0**53)
        self.char = np.full(0x110000, -1, np.int32)
        for code, symbol in p.chars.items():
            self.char[code] = symbol
        self.char[ord(" ")], self.char[SPACE] = self.char[SPACE], -1
        self.width = np.int64(p.size + len(p.extra))
        keys = p.left * self.width + p.right
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NEVER, np.int32)
        self.targets = np.zeros(1 << self.BITS, np.int32)
        for key, rank, target, at in zip(
            keys.tolist(), p.rank.tolist(), p.merged.tolist(), self._slot(keys).tolist(), strict=True
        ):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.ranks[at], self.targets[at] = key, rank, target

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        hashed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (hashed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def pairs(
        self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, borders: tuple[np.ndarray, ...]
    ) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; dropped and unknown pairs rank ``NEVER``."""
        key = a * self.width + b
        at = self._slot(key)
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        rank = np.where(self.keys[at] == key, self.ranks[at], NEVER)
        if self.limit:
            hashed = doc.copy()
            for place, border in zip(_PLACE, borders, strict=False):
                hashed += border.astype(np.uint64) * place
            rank[(mix(hashed) >> np.uint64(11)) < self.limit] = NEVER
        return rank, self.targets[at]

    def encode(self, texts: list[str], doc_ids: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text."""
        full = "".join([" " + t if t else "" for t in texts])
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        code = np.frombuffer(full.encode("utf-32-le", "surrogatepass"), "<u4")
        begin = np.cumsum(sizes) - sizes
        seeded = np.full(1, self.seed, np.int64).view(np.uint64) * _PLACE[3]
        keyed = mix(doc_ids.astype(np.int64).view(np.uint64) + seeded)
        symbol = self.char[code].astype(np.int64)
        end = np.arange(1, len(code) + 1)
        live = np.ones(len(code), bool)
        space = symbol == self.char[ord(" ")]
        cut = np.ones(len(code), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (symbol[1:] < 0) | (symbol[:-1] < 0)
        cut[begin[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(code)))
        doc = np.repeat(keyed, sizes)
        base = np.repeat(begin, sizes)
        short = (lengths > 1) & (lengths <= LONG)
        self._rounds(symbol, end, live, starts[short], lengths[short], doc, base)
        for at, n in zip(starts[lengths > LONG], lengths[lengths > LONG], strict=True):
            self._agenda(symbol, end, live, int(at), int(n), doc[at : at + 1], int(base[at]))
        # characters without a piece of their own become bytes
        alone = np.flatnonzero(live & ((symbol < 0) | (symbol >= self.p.size)))
        if not len(alone):
            ids = symbol[live].astype(np.int32)
            counts = np.add.reduceat(live, begin[sizes > 0]) if len(code) else np.zeros(0, np.int64)
        else:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[alone].tolist()]
            width = live.astype(np.int64)
            width[alone] = [len(r) for r in raw]
            ids = np.repeat(symbol[live], width[live]).astype(np.int32)
            first = np.cumsum(width) - width
            spots = np.repeat(first[alone], width[alone])
            inner = np.concatenate([np.arange(len(r)) for r in raw])
            ids[spots + inner] = self.p.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
            counts = np.add.reduceat(width, begin[sizes > 0])
        all_counts = np.zeros(len(texts), np.int64)
        all_counts[sizes > 0] = counts
        return np.split(ids, np.cumsum(all_counts)[:-1]) if len(texts) else []

    def _rounds(self, symbol, end, live, starts, lengths, doc, base) -> None:
        """Run the agendas of short chunks side by side: each round does one merge in each chunk."""
        if not len(starts):
            return
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        last = np.zeros(len(at), bool)
        last[np.cumsum(lengths) - 1] = True

        def rank(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = at[rows], at[rows + 1]
            own = base[a]
            return self.pairs(
                symbol[a], symbol[b], doc[a], (a - own, b - own, end[b] - own)
            )

        ranks = np.full(len(at), NEVER, np.int32)
        target = np.zeros(len(at), np.int32)
        rows = np.flatnonzero(~last)
        ranks[rows], target[rows] = rank(rows)
        while len(at):
            heads = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(ranks, heads)
            busy = least < NEVER
            if not busy.all():
                kept = np.repeat(busy, lengths)
                at, last, ranks, target = at[kept], last[kept], ranks[kept], target[kept]
                lengths, least = lengths[busy], least[busy]
                if not len(at):
                    return
            chunk = np.repeat(np.arange(len(lengths)), lengths)
            best = np.flatnonzero(ranks == least[chunk])
            which = chunk[best]
            leftmost = np.ones(len(best), bool)
            leftmost[1:] = which[1:] != which[:-1]
            best = best[leftmost]
            a, b = at[best], at[best + 1]
            symbol[a], end[a], live[b] = target[best], end[b], False
            last[best] = last[best + 1]
            kept = np.ones(len(at), bool)
            kept[best + 1] = False
            at, last, ranks, target = at[kept], last[kept], ranks[kept], target[kept]
            now = best - np.arange(len(best))
            lengths = lengths - 1
            heads = np.cumsum(lengths) - lengths
            ranks[now] = NEVER
            before = now[now > heads] - 1
            rows = np.concatenate([before, now[~last[now]]])
            ranks[rows], target[rows] = rank(rows)

    def _agenda(self, symbol, end, live, start, n, doc, base) -> None:
        """The agenda of one long chunk, as a heap."""
        after = list(range(start + 1, start + n)) + [-1]
        before = [-1, *range(start, start + n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: np.ndarray, b: np.ndarray) -> None:
            ranks, targets = self.pairs(
                symbol[a],
                symbol[b],
                np.repeat(doc, len(a)),
                (a - base, b - base, end[b] - base),
            )
            for x, y, r, t in zip(a.tolist(), b.tolist(), ranks.tolist(), targets.tolist(), strict=True):
                if r < NEVER:
                    heapq.heappush(heap, (r, x, y, int(end[y]), t))

        places = np.arange(start, start + n)
        offer(places[:-1], places[1:])
        while heap:
            _, a, b, stop, target = heapq.heappop(heap)
            if not (live[a] and live[b]) or after[a - start] != b or end[b] != stop:
                continue
            symbol[a], end[a], live[b] = target, stop, False
            nxt = after[a - start] = after[b - start]
            prev = before[a - start]
            if nxt >= 0:
                before[nxt - start] = a
            left = [x for x in (prev, a if nxt >= 0 else -1) if x >= 0]
            if left:
                right = [a if x == prev else nxt for x in left]
                offer(np.array(left), np.array(right))


def decode_ids(p: Pieces, ids: list[int]) -> str:
    """The text of piece ids; the space put before every text goes."""
    return b"".join([p.text[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode(
    docs: DataFrame, path: str = MODEL, dropout: float = 0.1, seed: int = 0, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(keep..., n_chars, ids, n_tokens, lossless) of every row.

    A null text has null ids, 0 tokens and counts as lossless; an empty one has no ids.
    ``lossless`` says that decoding gives back the text.  A literal U+2581 is written as
    bytes, so that it does not come back as a space.  Rows with equal doc_id and text are
    cut alike; a null doc_id counts as 0.  Long texts and long words are taken whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, dropout, seed)
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = batch.column(1).to_pylist()
                given = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
                ids = encoder.encode([t or "" for t in texts], given)
                same = [
                    not t or decode_ids(shared.value, i.tolist()) == t
                    for t, i in zip(texts, ids, strict=True)
                ]
                counts = np.array([len(i) for i in ids], np.int64)
                lists = list_column(np.concatenate(ids), counts, pa.int32())
                if batch.column(1).null_count:
                    lists = pa.array(
                        [None if t is None else i for t, i in zip(texts, ids, strict=True)],
                        pa.list_(pa.int32()),
                    )
                chars = pa.array([len(t or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[2:], chars, lists, pa.array(counts), pa.array(same)],
                    [*keep, "n_chars", "ids", "n_tokens", "lossless"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *keep
    )
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(
        run, f"{kinds}, n_chars long, ids array<int>, n_tokens long, lossless boolean"
    )


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Adds ``text`` decoded from ``ids``: null from null, empty from none."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda row: None if row is None else decode_ids(shared.value, row))

    return encoded.withColumn("text", text("ids"))
