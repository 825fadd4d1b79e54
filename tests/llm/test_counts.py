"""Token counts against the tokenizers library and against all segmentations."""

import itertools

import pytest

from oddledger.llm import counts
from tests.llm.conftest import AWKWARD

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [t or "" for _, t in AWKWARD] + [
    " ", "   x", "▁", "word▁word", "日本語テスト", "a" * 300, "<0x0A>", "<s>", "<unk>", "<unk><unk>",
    "<unk>😀", "😀<unk>", "😀<unk> <unk>a",
]


def library(vocabulary):
    tk = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    # the text is not cut before the search
    tk.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return lambda texts: [len(e.ids) for e in tk.encode_batch(texts, add_special_tokens=False)]


CODE = ["def f(x):\n    if x:\n        return  x\n", "a   b  ", "    x", "hello world again", "col1     col2\t3"]


def test_like_the_library():
    vocabulary = counts.load()
    counter = counts.Counter(vocabulary, kept=3)
    # merge ranks give equal sums far more often than probabilities do
    assert [counter.text(t) for t in TEXTS] == library(vocabulary)(TEXTS)


@pytest.fixture(scope="module")
def learned(spark):
    texts = [(t,) for t in TEXTS + CODE] + [("hello world again and again, the world says hello",)] * 50
    return counts.learn(spark.createDataFrame(texts, "text string").repartition(4))


def test_like_the_library_with_learned_scores(learned):
    counter = counts.Counter(learned)
    assert [counter.text(t) for t in TEXTS + CODE] == library(learned)(TEXTS + CODE)
    # as many as the file's own segmentation, and runs of blanks are not a piece a blank
    assert counter.text("hello world again") == 4
    assert counter.text("        return") < 6


def test_learned_scores_are_log_probabilities(spark, learned):
    import math

    assert abs(sum(math.exp(s) for _, s in learned) - 1) < 1e-9
    scores = dict(learned)
    assert scores["▁world"] > scores["▁river"]
    empty = counts.learn(spark.createDataFrame([], "text string"))
    assert len({s for _, s in empty}) == 1


def test_path_and_count_agree(learned):
    counter = counts.Counter(learned)
    for text in CODE + ["plain words only"]:
        for unit in counts.units(text):
            word = unit.replace(" ", counts.SPACE)
            parts = counter.pieces(word)
            if "".join(reversed(parts)) == word:
                assert len(parts) == counter.word(word)


def test_best_segmentation():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.5), ("ba", -4.0)]
    scores = dict(vocabulary)
    counter = counts.Counter(vocabulary)
    for word in map("".join, itertools.product("ab", repeat=6)):
        full = "▁" + word
        lengths = {}
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            spots = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(full)]
            parts = [full[a:b] for a, b in itertools.pairwise(spots)]
            if all(p in scores for p in parts):
                lengths.setdefault(sum(scores[p] for p in parts), set()).add(len(parts))
        assert counter.word(full) in lengths[max(lengths)]


def test_operator(awkward, documents):
    got = {(r["doc_id"], r["n_chars"]): r["n_tokens"] for r in counts.count_tokens(awkward).collect()}
    counter = counts.Counter(counts.learn(awkward))
    assert got == {(i, len(t or "")): counter.text(t or "") for i, t in AWKWARD}
    assert counts.count_tokens(documents([])).count() == 0


def test_frequent_units_are_counted_once_for_all_tasks(spark, monkeypatch):
    """The search is not made again in a task for the units that stand most often."""
    vocabulary = [("<unk>", -9.0), ("▁", -1.0), ("a", -2.0), ("b", -2.5), ("▁ab", -2.0)]
    df = spark.createDataFrame([(i, "ab ab ba ba  q") for i in range(4)], "doc_id long, text string")
    found = counts.frequent_units(counts.unit_counts(df), vocabulary, 2)
    plain = counts.Counter(vocabulary)
    assert found == {" ab": 1, " ba": plain.word("▁ba")}
    want = plain.text("ab ab ba ba  q")
    asked = []
    word = counts.Counter.word
    monkeypatch.setattr(counts.Counter, "word", lambda self, w: asked.append(w) or word(self, w))
    few = counts.Counter(vocabulary, kept=1, frequent=found)
    assert [few.text("ab ab ba ba  q") for _ in range(3)] == [want] * 3
    assert set(asked) == {"▁▁q"} and few.text("ab zz yy ab") == plain.text("ab zz yy ab")
    assert few.seen.keys() >= found.keys()
