"""Shared lines against a plain Python version and against the SQL."""

import random
import re

import duckdb
import pytest

from oddledger.llm import lines, sampling
from oddledger.llm.queries import SQL, op12_lines
from tests.llm.conftest import AWKWARD
from tests.oracle import compare

EDGE = re.compile(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, chars=40, documents=5):
    split = [(i, (t or "").split("\n")) for i, t in rows]

    def key(line):
        return EDGE.sub("", line).translate(UPPER)

    holders = {}
    for i, own in split:
        for line in own:
            if len(key(line)) >= chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, own in split:
        kept = [
            line
            for line in own
            if len(key(line)) < chars
            or len(holders.get(key(line), ())) < documents
            or i == max(holders[key(line)])
        ]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


def drawn(seed):
    draw = random.Random(seed)
    shared = [f"This Line is shared by many documents, Ünder number {k} " + "x" * k for k in range(8)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(draw.randint(0, 7)):
            line = draw.choice(shared) if draw.random() < 0.6 else f"only here {i} {draw.random()} " + "y" * 30
            if draw.random() < 0.5:
                line = draw.choice(["  {}\t", "{}\r", "\x0b{}\x0c", "{}"]).format(draw.choice([line, line.upper()]))
            own.append(line)
        rows.append((draw.choice([i, i, i, i // 10, None]), "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, documents, seed):
    rows = drawn(seed) + [(r[0], r[1]) for r in AWKWARD]
    assert found(lines.drop_lines(documents(rows))) == sorted(brute(rows), key=str)


def test_shuffled_keys_give_the_same(spark, documents, monkeypatch):
    rows = drawn(7)
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    assert found(lines.drop_lines(documents(rows))) == sorted(brute(rows), key=str)


def test_bounds_and_awkward_cases(spark, documents):
    line, short = "a" * 40, "b" * 39
    rows = [(i, f"{line}\n{short}\n\n") for i in range(5)] + [(9, None), (10, ""), (None, f"{line}\n{line}")]
    got = {r[0]: r[1:] for r in found(lines.drop_lines(documents(rows)))}
    assert got[4] == (4, 0, f"{line}\n{short}\n\n")
    assert got[0] == (4, 1, f"{short}\n\n")
    assert got[9] == got[10] == (1, 0, "")
    # without a doc_id a row never keeps a shared line
    assert got[None] == (2, 2, "")
    four = documents(rows[:4])
    assert all(r["n_dropped"] == 0 for r in lines.drop_lines(four).collect())
    # five rows of one document are one document
    same = documents([(1, line)] * 5)
    assert found(lines.drop_lines(same)) == [(1, 1, 0, line)] * 5
    assert lines.drop_lines(documents([])).count() == 0
    assert found(lines.drop_lines(documents(rows), lines.Shared(30, 2)))[0][2] == 3 - 1


def test_sql_on_drawn_rows(spark, documents, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents(drawn(3) + [(r[0], r[1]) for r in AWKWARD]).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    ok, message = compare(spark, con, "op12", op12_lines, SQL["op12_lines"], str(tmp_path))
    assert ok, message


def test_no_python_in_the_plan(spark, documents):
    plan = lines.drop_lines(documents(drawn(1)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
