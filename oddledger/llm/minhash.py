"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

A plain table of MinHash banding needs its own hashes for every table.  Here two
collections of ``side`` sub-keys of ``half`` hashes each are computed, and a table
key is a *pair* of sub-keys, one from each collection: ``2 * side * half`` hashes
serve ``side ** 2`` tables.  Documents that share a table key are candidates; their
whole shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddledger.llm.arrow import list_column, slices, utf8_column
from oddledger.llm.graph import components
from oddledger.llm.hashing import lowered_sets, mix, stream
from oddledger.session import staged

ROWS = 2048
# sets that one set is compared with at a time
COMPARED = 64


@dataclass(frozen=True)
class NearDup:
    """Parameters.  Two sets are linked when ``den * intersection >= num * union``.

    ``block`` bounds the shingles that one comparison task takes from one block.
    At similarity s a link is found with probability (1 - (1 - s^half)^side)^2:
    above 0.99997 at 0.85 and above 0.9995 at 0.8 with the defaults.
    """

    words: int = 5
    num: int = 85
    den: int = 100
    half: int = 4
    side: int = 16
    block: int = 1_000_000


def sketch(sets: list[np.ndarray], p: NearDup) -> np.ndarray:
    """Sub-keys of every set: ``side`` of the first collection, then of the second."""
    n = 2 * p.side * p.half
    factor = stream(21, n) | np.uint64(1)
    place = stream(22, p.half) | np.uint64(1)
    out = np.empty((len(sets), 2 * p.side), np.uint64)
    for row, items in enumerate(sets):
        least = np.full(n, np.iinfo(np.uint64).max)
        for at in range(0, len(items), ROWS):
            hashed = (items[at : at + ROWS, None] * factor) >> np.uint64(24)
            np.minimum(least, hashed.min(axis=0), out=least)
        out[row] = mix((least.reshape(-1, p.half) * place).sum(axis=1))
    return out


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, subs) of every row; no set, no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = lowered_sets(*utf8_column(batch.column(1)), p.words)
                subs = sketch(sets, p).view(np.int64)
                size = np.array([len(s) for s in sets], np.int64)
                width = np.where(size > 0, 2 * p.side, 0)
                digest = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(size),
                        pa.array(digest, pa.binary()),
                        list_column(subs[size > 0].ravel(), width, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "digest", "subs"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, subs array<long>"
    )


def candidates(classes: DataFrame, p: NearDup) -> DataFrame:
    """(a, b) star links of all tables: b shares a table key with a, the smallest of its bucket.

    Sub-keys that nobody shares go first, so only documents with a shared sub-key
    in both collections form table keys.
    """
    subs = classes.select("rep", F.posexplode("subs").alias("c", "sub"))
    shared = subs.groupBy("c", "sub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = subs.join(shared, ["c", "sub"])
    each = kept.groupBy("rep").agg(F.collect_list(F.struct("c", "sub")).alias("s"))
    first, second = (
        F.filter("s", lambda x: x["c"] < p.side),
        F.filter("s", lambda x: x["c"] >= p.side),
    )
    keys = (
        each.select("rep", F.explode(first).alias("x"), second.alias("ys"))
        .select("rep", "x", F.explode("ys").alias("y"))
        .select("rep", F.xxhash64("x.c", "x.sub", "y.c", "y.sub").alias("key"))
    )
    keys = staged(keys, "tables")
    lows = (
        keys.groupBy("key")
        .agg(F.min("rep").alias("a"), F.max("rep").alias("top"))
        .filter("a < top")
        .drop("top")
    )
    found = keys.join(lows, "key").filter("rep <> a")
    return found.select("a", F.col("rep").alias("b")).distinct()


def rarest_first(sets: list[np.ndarray], p: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, sets they stand in, probe, index): the shingles by which linked sets meet.

    With the shingles of every set ordered from the rarest among ``sets`` on, and sets from
    the smallest on, a set and a smaller one that is linked with it share one of the larger
    one's first n - ceil(s * n) + 1 (``probe``) and the smaller one's first
    n - ceil(2 * s / (1 + s) * n) + 1 (``index``) shingles, s the similarity.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, spot, times = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((spot, times[spot], owner))
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    probe = sizes - -(-p.num * sizes // p.den) + 1
    index = sizes - -(-2 * p.num * sizes // (p.num + p.den)) + 1
    return spot[order], owner, place < probe[owner], place < index[owner]


def forest(left: list[tuple], right: list[tuple] | None, p: NearDup) -> list[tuple[int, int]]:
    """Links that span all confirmed links within ``left``, or between ``left`` and ``right``.

    Items are (node, set).  Candidates share one of their rarest shingles, and pairs that
    are connected already are not compared.
    """
    items = sorted(
        [(len(s), 0, n, s) for n, s in left] + [(len(s), 1, n, s) for n, s in right or ()], key=lambda x: x[:3]
    )
    nodes = [n for _, _, n, _ in items]
    sets = [s for _, _, _, s in items]
    side = np.array([k for _, k, _, _ in items])
    sizes = np.array([len(s) for s in sets], np.int64)
    shingles, owner, probe, index = rarest_first(sets, p)
    by = np.argsort(shingles[index], kind="stable")
    known, holder = shingles[index][by], owner[index][by]
    asked, asker = shingles[probe], owner[probe]
    lo, hi = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
    first = np.searchsorted(asker, np.arange(len(sets) + 1))
    # rows of one node are one from the start
    group = np.unique(np.array(nodes, np.int64), return_inverse=True)[1]
    links = []
    for i in range(len(sets)):
        spans = [holder[a:b] for a, b in zip(lo[first[i] : first[i + 1]], hi[first[i] : first[i + 1]], strict=True) if b > a]
        if not spans:
            continue
        near = np.concatenate(spans)
        near = near[near < i]
        near = near[(p.den * sizes[near] >= p.num * sizes[i]) & (group[near] != group[i])]
        if right is not None:
            near = near[side[near] != side[i]]
        near = np.unique(near)
        while len(near):
            part, near = near[:COMPARED], near[COMPARED:]
            joined = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
            begin = np.cumsum(sizes[part]) - sizes[part]
            common = np.add.reduceat((sets[i][at] == joined).astype(np.int64), begin)
            fine = p.den * common >= p.num * (sizes[i] + sizes[part] - common)
            for j in part[fine]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
            near = near[group[near] != group[i]]
    return links


def confirmed(docs: DataFrame, groups: DataFrame, sizes: DataFrame, p: NearDup) -> DataFrame:
    """(a, b) links that connect what is linked within each candidate group.

    A group is cut into blocks by hash, so that a block holds about ``block``
    shingles; a task compares two blocks, and each set goes to the tasks of its block.
    """
    members = groups.join(sizes, F.col("node") == F.col("rep")).select(
        "node", F.col("component").alias("grp"), "n_shingles"
    )
    cut = (
        members.groupBy("grp")
        .agg(F.sum("n_shingles").alias("all"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("grp", F.ceil(F.col("all") / p.block).cast("int").alias("blocks"))
    )
    placed = members.join(cut, "grp").select(
        "node", "grp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    )
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("node"), "text")
        .filter("node is not null and text is not null")
        .join(placed, "node")
    )

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = lowered_sets(*utf8_column(batch.column(1)), p.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i) for i in (0, 2, 3, 4)),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "grp", "blocks", "own", "items"],
                )

    sets = texts.select("node", "text", "grp", "blocks", "own").mapInArrow(
        to_sets, "node long, grp long, blocks int, own int, items binary"
    )
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = sets.withColumn("with", F.explode(every)).select(
        "grp",
        F.least("own", "with").alias("x"),
        F.greatest("own", "with").alias("y"),
        "own",
        "node",
        "items",
    )

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        items = [np.frombuffer(b, np.uint64) for b in frame["items"]]
        rows = [r for r in zip(frame["own"], frame["node"], items, strict=True) if len(r[2])]
        left = [(int(n), s) for own, n, s in rows if own == x]
        right = None if x == y else [(int(n), s) for own, n, s in rows if own == y]
        found = forest(left, right, p) if left and (right or x == y) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.groupBy("grp", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, p: NearDup | None = None) -> DataFrame:
    """Every row of ``docs`` with n_shingles, component_id and kept.

    Reads doc_id and text; other columns are ignored.  Rows that share a doc_id are
    one node.  A row without a doc_id is linked with nothing: component_id is null,
    kept is true.  Null and empty texts have no shingles and are linked with nothing.
    Equal sets are one class before tables are formed, so copies cost one row each.
    """
    p = p or NearDup()
    signed = staged(signatures(docs, p), "signatures")
    usable = signed.filter("digest is not null and doc_id is not null")
    classes = staged(
        usable.groupBy("digest").agg(
            F.min("doc_id").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("subs").alias("subs"),
        ),
        "classes",
    )
    stars = candidates(classes, p)
    groups = staged(components(stars), "groups")
    links = staged(confirmed(docs, groups, classes.select("rep", "n_shingles"), p), "confirmed")
    several = classes.filter("copies > 1").select("digest", "rep")
    ids = signed.drop("subs").join(several, "digest", "left")
    ids = ids.withColumn("rep", F.coalesce("rep", "doc_id"))
    repeated = (
        ids.groupBy("doc_id")
        .agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and a < b")
        .select("doc_id", "a")
    )
    same_id = ids.join(repeated, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    joined = components(links.union(same_id))
    return ids.join(joined, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "rep").alias("component_id"),
        F.coalesce(F.coalesce("component", "rep") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
