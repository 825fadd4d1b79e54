"""Language identification: gradients, held-out accuracy, awkward rows."""

import random

import numpy as np

from oddledger.llm import bigru, language
from oddledger.llm.language import LanguageModel, document_probabilities
from tests.llm.conftest import AWKWARD

SYLLABLES = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ter", "pf"], "zz": ["ção", "nh", "lh", "ães"]}
SMALL = LanguageModel(documents=80, windows=3, epochs=6, steps=32)


def corpus(n=400):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(SYLLABLES))
        words = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(40)]
        rows.append((i, " ".join(words), lang))
    return rows


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bigru.start(3, 4, 1).items()}
    x, y = rng.integers(97, 101, (6, 5)), rng.integers(0, 4, 5)
    weight = rng.integers(0, 2, (6, 5)).astype(float)
    _, grads = bigru.gradients(p, x, y, weight)
    for name, at in (("ef", (2, 98)), ("eb", (7, 99)), ("uf", (4, 1)), ("ub", (8, 2)), ("v", (1, 4)), ("c", (2, 0))):
        sides = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += step
            sides.append(bigru.gradients(moved, x, y, weight)[0])
        assert abs((sides[0] - sides[1]) / 2e-2 - grads[name][at]) < 1e-3, name


def test_windows_of_a_batch_do_not_touch():
    net = bigru.start(4, 3, 2)
    texts = [b"short", b"", "längerer Text über mehrere Fenster".encode() * 4, b"x" * 64]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = document_probabilities(net, data, at, SMALL)
    for k, t in enumerate(texts):
        one = document_probabilities(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]), SMALL)
        assert np.allclose(together[:, k], one[:, 0], atol=1e-6)


def test_held_out_accuracy_and_no_use_of_labels(documents):
    rows = corpus()
    docs = documents(rows)
    got = {r["doc_id"]: r for r in language.identify(docs, SMALL).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got.values() if r["held_out"]]
    assert 50 < len(held) < 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0.0 <= r["score"] <= 1.0 for r in got.values())
    # the labels of held-out rows change nothing
    held_ids = {r["doc_id"] for r in held}
    other = documents([(i, t, "xx" if i in held_ids else lang) for i, t, lang in rows])
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(other, SMALL).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_awkward_rows(documents):
    docs = documents(corpus(100)[20:] + AWKWARD)
    got = language.identify(docs, SMALL)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == 80 + len(AWKWARD)
    none = [r for r in rows if r["lang_pred"] == "und"]
    # null, empty, blank and digits only
    assert len(none) == 5 and all(r["score"] == 0.0 for r in none)


def test_without_labels_or_rows(documents, awkward):
    assert {r["lang_pred"] for r in language.identify(awkward, SMALL).collect()} == {"und"}
    assert language.identify(documents([]), SMALL).count() == 0
