"""Whitening against exact fractions and NumPy."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from oddledger.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def table(spark, vectors):
    rows = [(i, v, 0, "x", "y") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def drawn(n, d, seed=1):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) * np.linspace(3, 0.5, d)
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(mixed)]


def exact(vectors):
    x = [[floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[j] for r in x), n) for j in range(d)]
    centred = [[r[j] - mean[j] for j in range(d)] for r in x]
    v = [[sum(r[a] * r[b] for r in centred) / n for b in range(d)] for a in range(d)]
    return x, np.array([[float(c) for c in r] for r in centred]), np.array([[float(c) for c in r] for r in v])


@pytest.mark.parametrize("n,d,seed", [(300, 12, 1), (40, 3, 2)])
def test_against_exact_fractions(spark, n, d, seed):
    vectors = drawn(n, d, seed)
    x, centred, v = exact(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    model = whiten.fit(table(spark, vectors).select("embedding").repartition(5))
    assert np.allclose(model.values, values[: min(8, d)], rtol=1e-12)
    got = whiten.whiten(table(spark, vectors).repartition(5)).collect()
    k = min(8, d)
    assert len(got) == n * k
    total = np.array(x).sum(axis=0)
    sign = {}
    for r in sorted(got, key=lambda r: (r["component"], r["vec_id"])):
        i, c = r["vec_id"], r["component"] - 1
        want = centred[i] @ axes[:, c] / np.sqrt(values[c])
        s = sign.setdefault(c, 1.0 if want * r["whitened"] >= 0 else -1.0)
        assert abs(s * r["whitened"] - want) < 1e-7
        assert int(r["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], total, strict=True))
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[c] / np.trace(v)) < 1e-9


def test_covariances_are_rounded_once(spark):
    vectors = drawn(200, 6, 5)
    x, _, v = exact(vectors)
    whole = np.array(x)
    n = len(x)
    centre = [int(t) // n for t in whole.sum(axis=0)]
    rest = [int(t) - n * c for t, c in zip(whole.sum(axis=0), centre, strict=True)]
    squares = [int(s) for s in whiten.square_sums(whole - np.array(centre))]
    assert (whiten.covariance(n, rest, squares) == v).all()
    # large entries take the way of Python integers
    big = (whole - np.array(centre)) * (1 << 40)
    assert [int(s) for s in whiten.square_sums(big)] == [s << 80 for s in squares]
    assert whiten.column_sums(np.full((4, 1), 1 << 61)).tolist() == [1 << 63]


def test_rows_left_out_and_kept(spark):
    good = drawn(50, 4)
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0])]
    odd += [(103, [float("inf"), 1.0, 2.0, 3.0]), (104, []), (105, [1.0, 2.0, 3.0]), (106, [1.0] * 5)]
    kept = [(None, good[0][1]), (0, good[0][1])]
    got = whiten.whiten(table(spark, good + odd + kept)).collect()
    assert len(got) == 52 * 4 and {r["n"] for r in got} == {52}
    ids = {r["vec_id"] for r in got}
    assert None in ids and not ids & {v[0] for v in odd}
    same = sorted((r["component"], r["whitened"]) for r in got if r["vec_id"] is None)
    assert {tuple(p) for p in same} <= {(r["component"], r["whitened"]) for r in got if r["vec_id"] == 0}


def test_without_variance_or_rows(spark):
    got = whiten.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got} == {(0.0, 0.0, 0.0, 0)}
    one = whiten.whiten(table(spark, [(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert {r["explained"] for r in one} == {0.0, 1.0} and max(r["identity_error"] for r in one) < 1e-9
    for rows in ([], [(1, None), (2, [])]):
        empty = whiten.whiten(table(spark, rows))
        assert empty.count() == 0
        assert empty.columns[:3] == ["vec_id", "component", "n"]


def test_very_large_entries(spark):
    vectors = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [1.0, 3.0])]
    got = whiten.whiten(table(spark, vectors)).collect()
    assert len(got) == 6 and all(np.isfinite(r["whitened"]) for r in got)
