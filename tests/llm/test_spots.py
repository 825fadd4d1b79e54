"""SpotSigs against a plain reading of the texts and against all pairs."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from oddledger.llm import spots
from oddledger.llm.spots import Spots, edited, fingerprints, length_class, likeness, written
from tests.llm.conftest import AWKWARD


def word_list(text):
    folded = re.sub(r"[!-/:-@\[-`{-\x7f]", " ", text)
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.split(r"[\x20\x09-\x0d]+", folded) if w]


def chains(text, p, anchors):
    """Signatures as tuples of words."""
    words = word_list(text)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [x for x in words[i:] if x not in anchors][:: p.spread][: p.chain]
            if len(content) == p.chain:
                out.add((w, *content))
    if len(out) < p.few:
        runs = {("", *words[i : i + p.chain]) for i in range(len(words) - p.chain + 1)}
        out |= runs or ({("", *words)} if words else set())
    return out


def hashes_of(anchors):
    return np.sort(np.array([spots._hashed([w])[0][0] for w in anchors], np.uint64))


ANCHORS = "a an the is are was were be of to in on".split()


def corpus(n):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ANCHORS * 2
    out = []
    for _ in range(n):
        text = draw.choices(words, k=draw.choice([2, 30, 80]))
        out.append(" ".join(text))
        for _ in range(draw.choice([0, 0, 1, 2])):
            copy = list(text)
            copy[draw.randrange(len(copy))] = "other"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("p", [Spots(), Spots(chain=2, spread=3)])
def test_same_likeness_as_sets_of_chains(p):
    texts = corpus(30) + [t or "" for _, t in AWKWARD]
    signs, sets = fingerprints(texts, p, hashes_of(ANCHORS)), [chains(t, p, ANCHORS) for t in texts]
    assert [len(s) for s in signs] == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert likeness(signs[i], signs[j]) == want
            if want < 0.8:
                assert likeness(signs[i], signs[j], 0.8) in (0.0, want)


def test_operator(documents, spark):
    texts = corpus(40)
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    anchors = spots.common_words(documents(rows), Spots())
    got = spots.fingerprint(documents(rows).repartition(5)).collect()
    rows.sort()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = edited(text, after)
        own, other, nxt = fingerprints([text, changed, after], Spots(), anchors)
        r = by_id[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(own), written(other))
        assert (r["near_edited"], r["near_next"]) == (likeness(own, other), likeness(own, nxt))


def test_anchors_are_the_words_of_most_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(spots, "KEPT_WORDS", 20)
    texts = corpus(50) + [None, ""]
    held = {}
    for text in texts:
        for w in set(word_list(text or "")):
            held[w] = held.get(w, 0) + 1
    p = Spots(anchors=9)
    top = sorted((-n, int(hashes_of([w]).view(np.int64)[0])) for w, n in held.items() if n > 1)[:9]
    got = spots.common_words(documents(list(enumerate(texts))).repartition(7), p)
    assert sorted(got.view(np.int64).tolist()) == sorted(h for _, h in top)


def test_any_language_is_told_apart(spark, documents):
    draw = random.Random(4)
    sounds = ["ża", "łó", "szcz", "rze", "ny", "wą", "ki", "бо", "ла", "и"]
    long = [" ".join("".join(draw.choices(sounds, k=3)) for _ in range(200)) for _ in range(4)]
    for rows in (long, ["日本語の文章です " * 3 + f"番号 {i} 番" for i in range(3)] + ["x = 1; y = 2; print(x, y, x + y)"]):
        got = spots.fingerprint(documents(list(enumerate(rows)))).collect()
        assert all(r["n_signatures"] > 3 for r in got)
    got = spots.fingerprint(documents(list(enumerate(long)))).collect()
    assert all(0.4 < r["near_edited"] < 1 and r["near_next"] < 0.1 for r in got)


def test_awkward_rows(awkward, documents):
    got = spots.fingerprint(awkward).collect()
    assert len(got) == len(AWKWARD)
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = [
        (i, sha256(edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest())
        for k, (i, t) in enumerate(order)
    ]
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert spots.fingerprint(documents([])).count() == 0
    alone = spots.fingerprint(documents([(1, "the only one text of all here")])).first()
    assert alone["near_next"] == 1.0


def test_similar_pairs_by_brute_force(documents, spark):
    texts = corpus(80)
    prints = spots.fingerprint(documents(list(enumerate(texts))))
    for least in (0.5, 0.8):
        got = {(r["a"], r["b"]): r["likeness"] for r in spots.similar(prints, least).collect()}
        signs = fingerprints(texts, Spots(), spots.common_words(documents(list(enumerate(texts))), Spots()))
        first = {}
        for i, s in enumerate(signs):
            if len(s):
                first.setdefault(written(s), i)
        ids = sorted(first.values())
        want = {
            (a, b): likeness(signs[a], signs[b])
            for b in ids
            for a in ids
            if a < b and likeness(signs[a], signs[b]) >= least
        }
        assert got == want


def test_length_classes():
    for least in (0.5, 0.8, 0.95):
        for a in range(1, 60):
            for b in range(a, 60):
                if a >= least * b:
                    assert length_class(b, least) - length_class(a, least) in (0, 1)
