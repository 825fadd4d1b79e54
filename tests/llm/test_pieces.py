"""Encoding against the tokenizer's own library, and exact round trips."""

import numpy as np
import pytest

from oddledger.llm import pieces
from tests.llm.conftest import AWKWARD

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [t for _, t in AWKWARD if t and "▁" not in t] + [
    " two  spaces ", "tabs\tand\nlines", "日本語テスト", "a" * 300, " " * 90 + "end", "<0x0A><s>", "ﬁ é́ １",
]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_without_dropout_like_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.Encoder(model, 0.0, 1).encode(TEXTS, np.arange(len(TEXTS)))
    assert [g.tolist() for g in got] == sp.encode(TEXTS, num_threads=1)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_round_trip(model, dropout):
    texts = [t or "" for _, t in AWKWARD]
    got = pieces.Encoder(model, dropout, 5).encode(texts, np.arange(len(texts)))
    assert [pieces.decode_ids(model, g.tolist()) for g in got] == texts


def test_rounds_and_heap_agree(model, monkeypatch):
    texts = [t for t in TEXTS if len(t) < 1000]
    encoder = pieces.Encoder(model, 0.3, 9)
    monkeypatch.setattr(pieces, "LONG", 10**9)
    rounds = encoder.encode(texts, np.arange(len(texts)))
    monkeypatch.setattr(pieces, "LONG", 1)
    heap = encoder.encode(texts, np.arange(len(texts)))
    assert [r.tolist() for r in rounds] == [h.tolist() for h in heap]


def brute(model, text, dropout, seed, doc_id):
    """The agenda, one merge after another over all pairs."""
    encoder = pieces.Encoder(model, dropout, seed)
    seeded = np.full(1, seed, np.int64).view(np.uint64) * pieces._PLACE[3]
    doc = pieces.mix(np.full(1, doc_id, np.int64).view(np.uint64) + seeded)
    parts = [(encoder.char[ord(c)], i, i + 1) for i, c in enumerate(" " + text)]
    while True:
        best = None
        for k in range(len(parts) - 1):
            (a, x, y), (b, _, z) = parts[k], parts[k + 1]
            if a < 0 or b < 0:
                continue
            rank, merged = encoder.pairs(
                np.array([a], np.int64), np.array([b], np.int64), doc, tuple(np.array([v]) for v in (x, y, z))
            )
            if rank[0] < pieces.NEVER and (best is None or rank[0] < best[0]):
                best = (rank[0], k, merged[0], x, z)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [best[2:]]
    return [int(p[0]) for p in parts]


def test_dropout_like_a_plain_agenda(model):
    text = "the quick brown foxes were jumping over lazily sleeping dogs  again"
    for seed in (1, 2):
        got = pieces.Encoder(model, 0.3, seed).encode([text], np.array([17]))[0].tolist()
        assert got == brute(model, text, 0.3, seed, 17)


def test_seed_and_document_vary_the_cut(model):
    text = "segmentation varies with the seed and with the document"
    cuts = {
        tuple(pieces.Encoder(model, 0.3, seed).encode([text], np.array([doc]))[0].tolist())
        for seed in (1, 2)
        for doc in (1, 2)
    }
    assert len(cuts) == 4


def test_operator(awkward, documents):
    got = pieces.encode(awkward, seed=3)
    rows = got.collect()
    assert len(rows) == len(AWKWARD) and all(r["lossless"] for r in rows)
    assert all((r["ids"] is None) or len(r["ids"]) == r["n_tokens"] for r in rows)
    back = sorted(str(r["text"]) for r in pieces.decode(got).collect())
    assert back == sorted(str(t) for _, t in AWKWARD)
    assert pieces.encode(documents([])).count() == 0
