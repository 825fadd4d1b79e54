"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Anchors are the words that the most documents hold, whatever the language.  Wherever one
stands, the next ``chain`` content words at distance ``spread`` form a signature; a text with
few of them has a signature at every word too.  A fingerprint is the set of a text's
signatures.  Likeness is the Jaccard
similarity of two sets; sets whose lengths alone rule it out are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.llm.arrow import slices
from oddledger.llm.hashing import mix, stream, words
from oddledger.session import shuffle_partitions

_PLACE = stream(41, 8) | np.uint64(1)
# distinct words that a task adds up before it hands them on
KEPT_WORDS = 1_000_000


@dataclass(frozen=True)
class Spots:
    """Signatures of ``chain`` content words, ``spread`` content words apart.

    Anchors are the ``anchors`` commonest words, of those in at least two documents.  A text
    with fewer than ``few`` signatures has one for every run of ``chain`` words besides.
    """

    chain: int = 3
    spread: int = 1
    anchors: int = 128
    few: int = 6


# ends of words that carry punctuation would hide anchors and content words alike
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 128) if not chr(c).isalnum()]] = 32


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of the first word of each text plus the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    return words(_PLAIN[np.frombuffer(b"".join(raw), np.uint8)], at)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, spot = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, spot, np.concatenate([n for _, n in parts]))
    return found, total


def common_words(docs: DataFrame, p: Spots) -> np.ndarray:
    """Sorted hashes of the words in the most documents, counted over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def put() -> pa.RecordBatch:
            found, total = _added(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, first = _hashed([t or "" for t in batch.column(0).to_pylist()])
                own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                parts.append(np.unique(np.concatenate(own), return_counts=True))
                held += len(parts[-1][0])
                if held > KEPT_WORDS:
                    parts[:] = [_added(parts)]
                    held = len(parts[0][0])
                    if held > KEPT_WORDS // 2:
                        yield put()
                        held = 0
        if parts:
            yield put()

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(p.anchors).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def fingerprints(texts: list[str], p: Spots, anchors: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text.

    A text shorter than a chain has one signature, the hash of all its words, so that equal
    texts are still equal; a text without words has none.
    """
    hashes, first = _hashed(texts)
    common = np.zeros(len(hashes), bool)
    if len(anchors):
        spot = np.searchsorted(anchors, hashes)
        common = anchors[np.minimum(spot, len(anchors) - 1)] == hashes
    out = []
    reach = p.spread * (p.chain - 1)
    for a, b in zip(first[:-1], first[1:], strict=True):
        own, here = hashes[a:b], common[a:b]
        content = own[~here]
        # number of content words before each anchor: where its chain begins
        begin = np.cumsum(~here)[here]
        full = begin + reach < len(content)
        begin = begin[full]
        total = own[here][full] * _PLACE[0]
        for j in range(p.chain):
            total += content[begin + j * p.spread] * _PLACE[j + 1]
        signs = np.unique(mix(total))
        if len(signs) < p.few:
            if len(own) >= p.chain:
                total = np.zeros(len(own) - p.chain + 1, np.uint64)
                for j in range(p.chain):
                    total += own[j : len(own) - p.chain + 1 + j] * _PLACE[j + 1]
                more = mix(total)
            elif len(own):
                place = mix(np.arange(1, len(own) + 1, dtype=np.uint64)) | np.uint64(1)
                more = mix((own * place).sum(keepdims=True))
            else:
                more = own
            signs = np.concatenate([signs, more])
        out.append(np.unique((signs >> np.uint64(32)).astype(np.uint32)))
    return out


def written(signs: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each signature, in rising order."""
    return signs.astype(">u4").tobytes().hex()


def bound(a: int, b: int) -> float:
    """The largest Jaccard similarity that sets of these lengths can have."""
    return min(a, b) / max(a, b) if a and b else float(a == b)


def length_class(n: int, least: float) -> int:
    """Partition of a set by length: pairs from ``least`` on are in equal or neighbouring ones."""
    return int(np.floor(np.log(n) / -np.log(least))) if n else -1


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 when the lengths show that it is below ``least``.

    Two empty sets are alike (1).
    """
    if bound(len(a), len(b)) < least:
        return 0.0
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _starts(docs: DataFrame) -> list[int]:
    """First doc_id of each of at most ``shuffle_partitions`` runs of documents, rising."""
    parts = shuffle_partitions(docs.sparkSession)
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"))
    found = (
        ids.repartitionByRange(parts, "doc_id")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("doc_id").alias("low"))
        .collect()
    )
    return sorted(r["low"] for r in found)


def _in_order(docs: DataFrame) -> DataFrame:
    """(run, late, doc_id, text) with each run of documents sorted in one partition.

    The first document of a run comes to the run before as well, marked ``late`` and last,
    where it is the next of that run's last document; the very first follows the very last.
    Null ids form the first run.
    """
    starts = _starts(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    nulls = bool(rows.filter("doc_id is null").limit(1).count())
    lows: list[int | None] = [None, *starts] if nulls else list(starts)
    table = docs.sparkSession.sparkContext.broadcast(np.array(starts, np.int64))
    count, shift = len(lows), int(nulls)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy()
            home = np.searchsorted(table.value, value, "right") - 1
            opens = known & (table.value[home] == value) if len(table.value) else known & False
            run = np.where(known, home + shift, 0)
            opens |= ~known
            extra = np.flatnonzero(opens)
            order = np.concatenate([np.arange(len(run)), extra])
            late = np.concatenate([np.zeros(len(run), bool), np.ones(len(extra), bool)])
            to = np.concatenate([run, (run[extra] - 1) % max(count, 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(late), *(c.take(pa.array(order)) for c in batch.columns)],
                ["run", "late", "doc_id", "text"],
            )

    spread = rows.mapInArrow(place, "run long, late boolean, doc_id long, text string")
    return spread.repartition(max(count, 1), "run").sortWithinPartitions(
        "run", "late", F.col("doc_id").asc_nulls_first(), "text"
    )


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint(docs: DataFrame, p: Spots | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its fingerprint and that of its edited text.

    The next document is the next row by (doc_id, text); the first follows the last, and a
    lone document follows itself.  Null texts are empty; null ids come first.
    """
    p = p or Spots()
    anchors = common_words(docs, p)
    names = [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "n_signatures",
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column(3).to_pylist()
                signs = fingerprints(texts, p, anchors)
                pairs = []
                for row in zip(
                    batch.column(0).to_pylist(),
                    batch.column(1).to_pylist(),
                    batch.column(2).to_pylist(),
                    texts,
                    signs,
                    strict=True,
                ):
                    if held is not None and not held[1] and held[0] == row[0]:
                        pairs.append((held, row))
                    held = row
                if pairs:
                    yield _rows(pairs)

    def _rows(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(a[3], b[3]) for a, b in pairs]
        signs = fingerprints(changed, p, anchors)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([written(a[4]) for a, _ in pairs]),
                pa.array([written(s) for s in signs]),
                pa.array([likeness(a[4], s) for (a, _), s in zip(pairs, signs, strict=True)]),
                pa.array([likeness(a[4], b[4]) for a, b in pairs]),
                pa.array([len(a[4]) for a, _ in pairs], pa.int64()),
            ],
            names,
        )

    return _in_order(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, n_signatures long",
    )


def _signs(column: str) -> Column:
    """Signatures of a written fingerprint."""
    n = F.length(column) / 8
    spots = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substr(F.col(column), i * 8 + 1, F.lit(8)))


def similar(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of different fingerprints from ``least`` on, a < b.

    ``prints`` has doc_id and fingerprint.  Equal fingerprints are one class, shown by its
    smallest doc_id.  Sets are partitioned by length, so that only equal and neighbouring
    partitions meet; there the rarest signatures of a set bring candidates together: a pair
    from ``least`` on shares one of the first n - ceil(least * n) + 1.
    """
    classes = (
        prints.filter("doc_id is not null and fingerprint <> ''")
        .groupBy("fingerprint")
        .agg(F.min("doc_id").alias("doc_id"))
        .select("doc_id", _signs("fingerprint").alias("signs"))
        .withColumn("n", F.size("signs"))
        .withColumn("part", F.floor(F.log("n") / F.lit(-np.log(least)) + 1e-9))
    )
    each = classes.select("doc_id", "n", "part", F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count(F.lit(1)).alias("often"))
    ranked = (
        each.join(often, "sign")
        .groupBy("doc_id", "n", "part")
        .agg(F.sort_array(F.collect_list(F.struct("often", "sign"))).alias("s"))
    )
    head = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    keys = ranked.select("doc_id", "n", "part", F.explode(head).alias("k")).select(
        "doc_id", "n", "part", F.col("k.sign").alias("sign")
    )
    left = keys.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "part", "sign")
    right = keys.select(
        F.col("doc_id").alias("y"),
        F.col("n").alias("ny"),
        F.explode(F.array("part", F.col("part") - 1)).alias("part"),
        "sign",
        F.col("part").alias("own"),
    )
    ordered = (F.col("own") > F.col("part")) | (F.col("x") < F.col("y"))
    pairs = (
        left.join(right, ["part", "sign"])
        .filter(ordered & (F.least("nx", "ny") >= least * F.greatest("nx", "ny") - 1e-9))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    full = classes.select("doc_id", "signs")
    common = F.size(F.array_intersect("sa", "sb"))
    score = common / (F.size("sa") + F.size("sb") - common)
    return (
        pairs.join(full.withColumnsRenamed({"doc_id": "a", "signs": "sa"}), "a")
        .join(full.withColumnsRenamed({"doc_id": "b", "signs": "sb"}), "b")
        .select("a", "b", score.alias("likeness"))
        .filter(F.col("likeness") >= least)
    )
