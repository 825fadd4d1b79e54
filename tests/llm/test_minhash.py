"""Near-duplicates against brute force over all pairs."""

import random
import time

import numpy as np
import pytest

from oddledger.llm import minhash
from oddledger.llm.graph import components
from oddledger.llm.minhash import NearDup
from tests.llm.conftest import AWKWARD


def shingles(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        folded = folded.replace(blank, " ")
    words = [w for w in folded.split(" ") if w]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, num=85, den=100):
    """(doc_id, n_shingles, component_id, kept) of rows with doc_id."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def rows_of(df):
    return sorted(tuple(r) for r in df.filter("doc_id is not null").collect())


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        base = draw.choices(words, k=draw.choice([3, 40, 120]))
        for _ in range(draw.choice([1, 1, 1, 2, 5])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("num", "block"), [(85, 1_000_000), (80, 200)])
def test_equals_brute_force(documents, num, block):
    rows = corpus(60)
    got = minhash.near_duplicates(documents(rows), NearDup(num=num, block=block))
    assert rows_of(got) == brute(rows, num)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("halves", [False, True])
def test_forest_connects_what_is_linked(seed, halves):
    draw = np.random.default_rng(seed)
    p = NearDup()
    items = []
    for k in range(60):
        base = draw.integers(0, 2**62, draw.integers(1, 60), dtype=np.uint64)
        for _ in range(draw.integers(1, 5)):
            own = base.copy()
            own[draw.integers(0, len(own), len(own) // 14)] = draw.integers(0, 2**62, len(own) // 14, dtype=np.uint64)
            items.append((len(items), np.unique(own)))
    draw.shuffle(items)
    cut = len(items) // 2
    left, right = (items[:cut], items[cut:]) if halves else (items, None)
    got = minhash.forest(left, right, p)
    sets = dict(items)
    pairs = [(a, b) for a, _ in left for b, _ in (right or left) if right or a < b]
    want = [(a, b) for a, b in pairs if len(np.intersect1d(sets[a], sets[b])) * 100 >= 85 * len(np.union1d(sets[a], sets[b]))]

    def parts(links):
        parent = list(range(len(items)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        return [sorted(i for i in range(len(items)) if root(i) == root(k)) for k in range(len(items))]

    assert parts(got) == parts(want) and want
    assert all(tuple(sorted(link)) in {tuple(sorted(w)) for w in want} for link in got)


def test_many_alike_but_unlinked_sets_take_little_time():
    """14 of 16 shingles are common to all, which links none."""
    draw = np.random.default_rng(1)
    common = draw.integers(0, 2**62, 14, dtype=np.uint64)
    items = [(i, np.sort(np.concatenate([common, draw.integers(0, 2**62, 2, dtype=np.uint64)]))) for i in range(20_000)]
    start = time.perf_counter()
    assert minhash.forest(items, None, NearDup()) == []
    assert time.perf_counter() - start < 10
    near = [(i, np.sort(np.append(common, draw.integers(0, 2**62, 1, dtype=np.uint64)))) for i in range(5_000)]
    assert len(minhash.forest(near, None, NearDup())) == 4_999
    assert time.perf_counter() - start < 20


def test_awkward_rows(awkward):
    got = minhash.near_duplicates(awkward)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(got) == brute(AWKWARD)
    missing = got.filter("doc_id is null").collect()
    assert len(missing) == 2 and all(r["kept"] and r["component_id"] is None for r in missing)


def test_rows_with_one_id_are_one_node(documents):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = minhash.near_duplicates(documents([(4, a), (9, a), (9, b), (2, b)]))
    assert {r["component_id"] for r in got.collect()} == {2}


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_recall_of_tensored_tables():
    p = NearDup()
    draw = np.random.default_rng(1)
    found, n = 0, 300
    for _ in range(n):
        base = draw.integers(0, 2**63, 190, dtype=np.uint64)
        a, b = minhash.sketch([np.sort(base[:175]), np.sort(base[15:])], p)
        same = a == b
        found += same[: p.side].any() and same[p.side :].any()
    # 160 of 190 shingles shared: 0.842
    assert found >= 0.99 * n


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(7, 7), (None, 3)]
    links += [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, root(x)) for x in parent)


def test_components_of_long_chains_hubs_and_odd_ends(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    hub = [(n, 100) for n in range(101, 400)] + [(100, 50), (50, 60)]
    odd = [(None, 3), (3, None), (None, None), (700, 700), (5, 5), (800, 801), (801, 800), (800, 801)]
    links = spark.createDataFrame(chain + hub + odd, "a long, b long")
    got = sorted(tuple(r) for r in components(links).collect())
    expected = dict.fromkeys(range(0, 41), 0) | dict.fromkeys([50, 60, *range(100, 400)], 50)
    assert got == sorted((expected | {700: 700, 800: 800, 801: 800}).items())
    assert components(links.filter("a = -1")).collect() == []
    assert [tuple(r) for r in components(links.filter("a = 700")).collect()] == [(700, 700)]
