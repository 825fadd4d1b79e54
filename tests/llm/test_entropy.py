"""Cross-entropy difference against plain counting."""

import math
from collections import Counter

import pytest

from oddledger.llm import entropy
from oddledger.llm.entropy import Entropy
from tests.llm.conftest import AWKWARD


def brute(rows, targets, symbols):
    """{(doc_id, text): (tokens, loss by the target model, by the background model)}."""
    texts = [t for _, t in rows if t]
    seen = Counter(c for t in texts for c in t)
    common = sorted(seen.items(), key=lambda k: (-k[1], k[0]))[: symbols - 2]
    number = {c: i + 2 for i, (c, _) in enumerate(common)}
    size = len(number) + 2

    def grams(text):
        s = [0, 0, *(number.get(c, 1) for c in text), 0]
        return list(zip(s, s[1:], s[2:], strict=False))

    def model(texts):
        n3 = Counter(g for t in texts for g in grams(t))
        n2, n1, c3, k3, c2, k2 = (Counter() for _ in range(6))
        for (a, b, c), n in n3.items():
            n2[b, c] += n
            n1[c] += n
            c3[a, b] += n
            k3[a, b] += 1
        for (b, _), n in n2.items():
            c2[b] += n
            k2[b] += 1
        total = sum(n1.values())

        def p(a, b, c):
            q = (n1[c] + 1) / (total + size)
            if c2[b]:
                q = (n2[b, c] + k2[b] * q) / (c2[b] + k2[b])
            if c3[a, b]:
                q = (n3[a, b, c] + k3[a, b] * q) / (c3[a, b] + k3[a, b])
            return q

        return p

    both = model([t for i, t in rows if t and i in targets]), model(texts)
    out = {}
    for i, t in rows:
        g = grams(t) if t else []
        means = [-sum(math.log(m(*x)) for x in g) / max(len(g), 1) for m in both]
        out[i, t] = (len(g), *means)
    return out


@pytest.mark.parametrize("symbols", [128, 8])
def test_equals_plain_counting(spark, documents, symbols):
    rows = AWKWARD[:9] + [(20, "abc abc abd"), (21, "xyz zyx"), (22, "abd abd " * 30), (23, "日本 é")]
    targets = {20, 22, 5}
    table = spark.createDataFrame([(i, 1) for i in [*targets, 20, 777]] + [(None, 1)], "doc_id long, quality int")
    got = entropy.score(documents(rows).repartition(3), table, Entropy(symbols)).collect()
    want = brute(rows, targets, symbols)
    assert len(got) == len(rows)
    by_id = {}
    for (i, _), values in want.items():
        by_id.setdefault(i, []).append(values)
    for r in got:
        assert any(
            r["n_tokens"] == n and abs(r["loss_target"] - a) < 1e-9 and abs(r["loss_background"] - b) < 1e-9
            for n, a, b in by_id[r["doc_id"]]
        )
        assert abs(r["score"] - (r["loss_target"] - r["loss_background"])) < 1e-12


def test_target_texts_score_lower(spark, documents):
    rows = [(i, "kala mala tala " * 9) for i in range(20)] + [(100 + i, "schpf ungter " * 9) for i in range(60)]
    targets = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in entropy.score(documents(rows), targets).collect()}
    assert max(got[i] for i in range(20)) < min(got[100 + i] for i in range(60))


def test_empty(spark, documents, awkward):
    none = spark.createDataFrame([], "doc_id long")
    assert entropy.score(documents([]), none).count() == 0
    assert entropy.score(awkward, none).count() == len(AWKWARD)


def test_every_character_is_a_symbol(spark, documents):
    """More characters than any fixed vocabulary of 128 holds, all about as common."""
    rows = [(i, "".join(chr(0x4E00 + (i * 37 + 11 * j) % 900) for j in range(60))) for i in range(40)]
    targets = set(range(0, 40, 4))
    table = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    got = entropy.score(documents(rows), table).collect()
    want = brute(rows, targets, 10**6)
    assert len(got) == len(rows)
    for r in got:
        n, a, b = next(v for (i, _), v in want.items() if i == r["doc_id"])
        assert r["n_tokens"] == n
        assert abs(r["loss_target"] - a) < 1e-9 and abs(r["loss_background"] - b) < 1e-9


def test_small_blocks_give_the_same(spark, documents, monkeypatch):
    rows = [(i, f"text {i} of some words " * (i % 5 + 1)) for i in range(60)]
    table = spark.createDataFrame([(i,) for i in range(9)], "doc_id long")
    whole = sorted(map(tuple, entropy.score(documents(rows), table).collect()))
    monkeypatch.setattr(entropy, "BLOCK_BYTES", 200)
    monkeypatch.setattr(entropy, "KEPT_KEYS", 10)
    parts = sorted(map(tuple, entropy.score(documents(rows), table).collect()))
    assert [r[:2] for r in parts] == [r[:2] for r in whole]
    assert all(abs(a - b) < 1e-9 for x, y in zip(parts, whole, strict=True) for a, b in zip(x, y, strict=True))
