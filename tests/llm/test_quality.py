"""Boosted trees and the quality operator."""

import random

import numpy as np

from oddledger.llm import quality
from oddledger.llm.boosting import Boosting, train
from oddledger.llm.quality import FEATURES, QualityModel, statistics
from tests.llm.conftest import AWKWARD

LABELS = "doc_id long, quality int, toxic int"


def test_trees_learn_a_rule_and_walk_alike():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = train(x[:2000], y[:2000], Boosting(trees=40))
    score = model.score(x[2000:])
    assert ((score > 0.5) == (y[2000:] > 0)).mean() > 0.97
    # one row at a time, node by node
    for row, want in zip(x[2000:2020], score[:20], strict=True):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (1 if row[f[node]] <= c[node] else 2)
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-12


def test_degenerate_training():
    assert train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (train(np.ones((40, 3)), np.ones(40)).score(np.ones((2, 3))) > 0.9).all()


def test_statistics_of_known_texts():
    texts = [b"", b"aa aa BB!\nx|\nx|\n"]
    at = np.array([0, 0, len(texts[1])])
    row = dict(zip(FEATURES, statistics(np.frombuffer(texts[1], np.uint8), at)[1], strict=True))
    assert row["distinct"] == 3 / 5 or row["distinct"] == 3 / 5.0
    assert row["repeat"] == 2 / 5 and row["lines"] == np.log1p(3)
    assert abs(row["line_copies"] - 1 / 3) < 1e-12
    assert not statistics(np.frombuffer(texts[1], np.uint8), at)[0].any()


def corpus(n=600):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(60)]
        good = draw.random() < 0.7
        text = " ".join(words) + "." if good else " ".join([draw.choice(words[:4])] * 40)
        rows.append((i, text))
        labels.append((i, int(good), None))
    return rows, labels


def test_held_out_accuracy_and_labels(spark, documents):
    rows, labels = corpus()
    held = set()
    table = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], LABELS)
    got = quality.classify(documents(rows), table).collect()
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"]:
            held.add(r["doc_id"])
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"])
    assert right >= 0.95 * len(held) > 0
    flipped = spark.createDataFrame([(i, 1 - q if i in held else q, None) for i, q, _ in labels], LABELS)
    again = quality.classify(documents(rows), flipped).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in got}


def test_awkward_and_empty(spark, awkward, documents):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0)], LABELS)
    got = quality.classify(awkward, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == len(AWKWARD)
    assert quality.classify(documents([]), labels).count() == 0
    assert quality.classify(awkward, labels.limit(0)).filter("score = 0.5").count() == len(AWKWARD)


def test_sample_is_bounded(spark, documents):
    rows, labels = corpus(200)
    model = quality.fit(documents(rows), spark.createDataFrame(labels, LABELS), QualityModel(rows=5))
    assert model.leaf.shape[1] == 16
