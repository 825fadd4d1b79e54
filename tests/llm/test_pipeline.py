"""The pipeline stage by stage against brute force, and what is left without it."""

import random
import subprocess
import sys

import pytest

import corpus_pipeline
from oddledger.llm import language, pieces, quality
from tests.llm.conftest import AWKWARD
from tests.llm.test_minhash import brute

ITEM = "Why does the old mill by the river stop for an hour on every second morning of the week?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small table of every kind of document, with labels and a benchmark."""
    draw = random.Random(4)
    sounds = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ter", "pf"]}
    rows, labels = [], []
    for i in range(300):
        lang = draw.choice(["xx", "yy"])
        words = ["".join(draw.choices(sounds[lang], k=draw.randint(1, 4))) for _ in range(60)]
        good = draw.random() < 0.75
        text = " ".join(words) + "." if good else " ".join([words[0]] * 60)
        rows.append((i, text, lang))
        labels.append((i, int(good), 0))
    base = rows[0][1].split()
    rows += [(1000, rows[0][1], "xx"), (1001, " ".join([*base[:-1], "other"]), None)]
    rows += [(1002, f"{rows[5][1]} {ITEM} {rows[6][1]}", None), (1003, "12 34", None)]
    rows += [(i, t, None) for i, t in AWKWARD]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(
        docs, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet"
    )
    return path


def plain(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near-duplicates", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert after.columns == docs.columns
        if name == "language":
            labels, net = language.fit(docs)
            found = language.with_language(docs, labels, net).collect()
            want = [r for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5]
            assert 300 <= len(want) < len(before)
        elif name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            want = [r for r in quality.with_quality(docs, model).collect() if r["score"] >= 0.7]
            assert 0 < len(want) < len(before)
        elif name == "near-duplicates":
            kept = {r[0] for r in brute([(r["doc_id"], r["text"]) for r in before], 80) if r[3]}
            seen, want = set(), []
            for r in before:
                if r["doc_id"] is None or (r["doc_id"] in kept and r["doc_id"] not in seen):
                    seen.add(r["doc_id"])
                    want.append(r)
            assert not {1000, 1001} & seen
        else:
            want = [r for r in before if ITEM not in (r["text"] or "")]
        assert plain(after) == sorted(((r["doc_id"], r["text"]) for r in want), key=str), name
        docs = after
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    model = pieces.load()
    assert all(r["lossless"] for r in encoded)
    back = sorted(((r["doc_id"], pieces.decode_ids(model, r["ids"])) for r in encoded), key=str)
    assert back == plain(docs)


def test_run_is_the_chain(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_chars", "ids", "n_tokens", "lossless"]
    assert 100 < got.count() < 310


def test_entry_works_without_these_modules():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('oddledger.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert names and not [n for n in names if n.startswith('op') or n == 'pipeline']\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
