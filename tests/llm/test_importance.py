"""Interning against a dict, resampling against plain Python and the SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from oddledger.llm import importance, intern
from oddledger.llm.arrow import utf8_column
from oddledger.llm.queries import SQL, op13_importance
from tests.llm.conftest import AWKWARD
from tests.oracle import compare

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, runs):
    w = WORD.findall((text or "").translate(UPPER))
    return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)], len(w)


def brute(rows, target, p):
    def totals(texts):
        return Counter(
            zlib.crc32(f.encode()) % p.buckets for t in texts for f in features(t, p.runs)[0]
        )

    s, t = totals(r[1] for r in rows), totals(target)
    n, m = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        own, words = features(text, p.runs)
        weight = 0
        for f in own:
            b = zlib.crc32(f.encode()) % p.buckets
            weight += math.floor(1000 * math.log((t[b] + 1) * (n + p.buckets) / ((s[b] + 1) * (m + p.buckets))))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(own), words, weight, score))
    able = sorted(
        (r for r in out if r[2] >= p.words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1])
    )
    drawn = able[: p.percent * len(able) // 100]
    ranks = {}
    for k, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=str)


def drawn(seed, n=120):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abcdeéß日", k=draw.randint(1, 12))) for _ in range(60)] + ["z" * 40, "Ü" * 31]
    rows = [(i, " ".join(draw.choice([w, w.upper(), w + "."]) for w in draw.choices(pool, k=draw.randint(0, 60)))) for i in range(n)]
    return rows, [r[1] for r in rows[:9]]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("runs", [1, 3])
def test_brute_force(spark, documents, runs):
    rows, target = drawn(runs)
    rows += [(r[0], r[1]) for r in AWKWARD]
    p = importance.Resampling(runs=runs, buckets=500, percent=30)
    want = brute(rows, target, p)
    goal = spark.createDataFrame([(t, 1) for t in [*target, None, ""]], "text string, weight int")
    assert found(importance.resample(documents(rows), goal, p)) == want


def test_small_and_empty_tables(spark, documents):
    goal = spark.createDataFrame([], "text string")
    assert importance.resample(documents([]), goal).count() == 0
    got = importance.resample(documents([(1, None), (2, "a b")]), goal).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 0, None), (2, 2, None)}


def test_sql_on_drawn_rows(spark, documents, tmp_path):
    rows, target = drawn(9)
    documents(rows + [(r[0], r[1]) for r in AWKWARD]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").coalesce(1).write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ok, message = compare(spark, con, "op13", op13_importance, SQL["op13_importance"], str(tmp_path))
    assert ok, message


def runs_of(words):
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    return data, np.cumsum(lengths) - lengths, lengths


def test_hashes_are_those_of_the_library():
    draw = random.Random(2)
    words = [draw.randbytes(n) for n in [*range(1, 70), 500] for _ in range(3)]
    data, starts, lengths = runs_of(words)
    assert intern.hashes(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


@pytest.mark.parametrize("crowded", [False, True])
def test_equal_bytes_share_a_slot(crowded):
    draw = random.Random(3)
    pool = [draw.randbytes(draw.choice([1, 2, 3, 7, 8, 9, 16, 31, 32, 33, 80])) for _ in range(40)]
    pool += [b"a" * 31 + b"b", b"a" * 32, b"abcdefgh1", b"abcdefgh2"]
    words = draw.choices(pool, k=600)
    data, starts, lengths = runs_of(words)
    # with one hash for all, the bytes alone tell runs apart
    same = np.full(len(words), 13, np.uint64) if crowded else None
    table = intern.intern(data, starts, lengths, zlib.crc32, same)
    by_slot = {}
    for w, s in zip(words, table.slots.tolist(), strict=True):
        assert by_slot.setdefault(s, w) == w
        assert table.bucket[s] == zlib.crc32(w)
    assert len(by_slot) == len(set(words))
    times = Counter(words)
    assert all(table.count[s] == times[w] for s, w in by_slot.items())


def test_no_words():
    data, at = utf8_column(pa.array(["", None, " .. "]))
    joined, starts, lengths, texts, words = importance.features(data, at, 2)
    assert len(starts) == len(lengths) == len(texts) == 0 and words.tolist() == [0, 0, 0]
    assert intern.intern(joined, starts, lengths, zlib.crc32).count.sum() == 0
