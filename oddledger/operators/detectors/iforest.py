"""Isolation forest: trees grown on hashed samples, scored on every row.

Follows the published method (Liu, Ting & Zhou 2008).  Sampling, tree growing
and scoring are Spark jobs; the NumPy helpers below handle one tree's sample
or one batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddledger.errors import AnalysisError
from oddledger.functions.columns import clamp
from oddledger.operators.detectors.base import (
    Detector,
    Transactions,
    is_number,
    register,
    require,
    scored,
)
from oddledger.operators.groups import (
    Split,
    global_quantiles,
    grouped_columns,
    join_side,
    merge_rows,
    position_rows,
)
from oddledger.operators.transform import with_time_features
from oddledger.session import durable, group_rows, shuffle_partitions, spread_small

AUTO_SAMPLE = 256
OVERSAMPLE = 1.5
SCORE_BLOCK = 200_000
# rows of whole accounts a task takes at once, and their points in all trees grown together
ACCOUNT_ROWS = 10_000
ACCOUNT_POINTS = 200_000
# slices of the hash that orders a sample no task may hold
SLICE_BITS = 12
# nodes of a forest that may go to every executor, or meet a block of rows; some 24 bytes each
FOREST_NODES = 2_000_000
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

NODES = ["feature", "threshold", "child", "path"]
PART = ["tree", "root", *NODES]
PART_FIELDS = (
    "tree int, root long, feature array<int>, threshold array<double>, child array<int>, path array<double>"
)


def c_factor(n):
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    mean = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, mean))


# -- draws: the same number for a node in NumPy and in a Spark expression ------------


def _hash(longs: list[np.ndarray], start: np.ndarray | None = None) -> np.ndarray:
    """Spark's ``hash`` of long columns (32-bit Murmur3, seed 42), or going on from ``start``."""

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    h = np.full(len(longs[0]), 42, np.uint32) if start is None else start
    for value in longs:
        bits = value.astype(np.int64).view(np.uint64)
        for word in (bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)):
            k = turn(word.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = h ^ (h >> np.uint32(16))
    return h


def _draws(hashed: np.ndarray, which: int) -> np.ndarray:
    """A number in [0, 1) from the hash of (seed, salt, tree, node)."""
    ends = (np.full(len(hashed), 2 * which + k) for k in (0, 1))
    high, low = (_hash([end], hashed).astype(np.uint64) for end in ends)
    return ((high % np.uint64(1 << 21) << np.uint64(32)) + low).astype(float) / float(1 << 53)


def node_draws(seed: int, salt: np.ndarray, tree: np.ndarray, node: np.ndarray, which: int) -> np.ndarray:
    """A number in [0, 1) for each node."""
    return _draws(_hash([np.full(len(node), seed), salt, tree, node]), which)


def node_draw_column(seed: int, which: int) -> Column:
    """``node_draws`` of the columns ``_salt``, ``tree`` and ``node``."""

    def word(k: int) -> Column:
        parts = [F.lit(seed), F.col("_salt"), F.col("tree"), F.col("node"), F.lit(2 * which + k)]
        return F.hash(*[c.cast("long") for c in parts]).cast("long")

    high, low = F.pmod(word(0), F.lit(1 << 21)), F.pmod(word(1), F.lit(1 << 32))
    return (high * F.lit(1 << 32) + low).cast("double") / float(1 << 53)


# -- growing ------------------------------------------------------------------------


@dataclass(frozen=True)
class Roots:
    """Where the growing begins: a node of a tree, numbered as in a heap from 1 on."""

    tree: np.ndarray
    node: np.ndarray
    salt: np.ndarray
    limit: np.ndarray


def grow_nodes(
    points: np.ndarray, at: np.ndarray, roots: Roots, seed: int
) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Grow all roots level by level; ``at`` is the root of every point, and every root has points.

    Gives the root of every node and the nodes, the roots first; ``child`` is the left child,
    the right one follows.
    """
    # a row for each feature; points of a node lie together
    part = points.T if (at[1:] >= at[:-1]).all() else points[np.argsort(at, kind="stable")].T
    part = np.ascontiguousarray(part)
    size = np.bincount(at, minlength=len(roots.tree))
    root, heap = np.arange(len(roots.tree)), roots.node.astype(np.int64)
    hashed = _hash([np.full(len(root), seed), roots.salt, roots.tree])
    depth = np.array([int(h).bit_length() - 1 for h in heap], np.int64)
    levels, made = [], 0
    while len(root):
        begin = np.cumsum(size) - size
        low, high = (np.stack([end.reduceat(x, begin) for x in part]) for end in (np.minimum, np.maximum))
        usable = high > low
        kinds = usable.sum(axis=0)
        cut = (depth < roots.limit[root]) & (kinds > 0)
        inner = np.flatnonzero(cut)
        drawn = _hash([heap[inner]], hashed[root[inner]])
        nth = np.floor(_draws(drawn, 0) * kinds[inner]).astype(np.int64)
        chosen = np.argmax(np.cumsum(usable[:, inner], axis=0) > nth, axis=0)
        bottom, top = low[chosen, inner], high[chosen, inner]
        with np.errstate(invalid="ignore"):
            border = bottom + _draws(drawn, 1) * (top - bottom)
            # a draw that hits the upper end goes to the lower one
            border = np.where(border < top, border, bottom)
        feature, threshold = np.full(len(root), -1), np.zeros(len(root))
        feature[inner], threshold[inner] = chosen, border
        child = np.full(len(root), -1)
        child[inner] = made + len(root) + 2 * np.arange(len(inner))
        path = np.where(cut, 0.0, depth + c_factor(size))
        levels.append((root, feature, threshold, child, path))
        made += len(root)
        kept, size = np.flatnonzero(np.repeat(cut, size)), size[inner]
        begin = np.cumsum(size) - size
        value = part.ravel()[np.repeat(chosen * part.shape[1], size) + kept]
        right = value > np.repeat(border, size)
        passed = np.append(0, np.cumsum(right))
        rights = passed[begin + size] - passed[begin]
        # within a node the points of the left child come first
        passed = passed[:-1] - np.repeat(passed[begin], size)
        place = np.where(right, np.repeat(begin + size - rights, size) + passed, np.arange(len(kept)) - passed)
        come = np.empty(len(kept), np.int64)
        come[place] = kept
        part = part[:, come]
        size = np.stack([size - rights, rights], axis=1).ravel()
        root, depth = np.repeat(root[inner], 2), np.repeat(depth[inner] + 1, 2)
        heap = np.repeat(2 * heap[inner], 2)
        heap[1::2] += 1
    of, *nodes = (np.concatenate(c) for c in zip(*levels, strict=True))
    return of, dict(zip(NODES, nodes, strict=True))


def grow_roots(points: np.ndarray, at: np.ndarray, roots: Roots, seed: int) -> list[dict[str, np.ndarray]]:
    """``grow_nodes`` as flat arrays for each root."""
    of, nodes = grow_nodes(points, at, roots, seed)
    # nodes of one root lie together, in the order they were made
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(roots.tree) + 1))
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of)) - begin[of[order]]
    nodes["child"] = np.where(nodes["child"] >= 0, place[nodes["child"]], -1)
    bounds = zip(begin[:-1], begin[1:], strict=True)
    return [{k: nodes[k][order[low:high]] for k in NODES} for low, high in bounds]


def whole_tree(parts: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Put the parts of a tree, by their root, together; a cut without child goes on in other parts."""
    if len(parts) == 1:
        return parts[1]
    feature, threshold, child, path = ([x] for x in (-1, 0.0, -1, 0.0))
    todo = [(1, 0)]
    while todo:
        root, slot = todo.pop()
        part = parts[root]
        grown = len(part["feature"])
        goes_on = grown == 1 and part["feature"][0] >= 0
        more = 2 if goes_on else grown - 1
        first = len(feature)
        for own, blank in ((feature, -1), (threshold, 0.0), (child, -1), (path, 0.0)):
            own.extend([blank] * more)
        feature[slot], threshold[slot], path[slot] = part["feature"][0], part["threshold"][0], part["path"][0]
        if goes_on:
            child[slot] = first
            todo += [(2 * root, first), (2 * root + 1, first + 1)]
            continue
        moved = np.where(np.asarray(part["child"]) >= 0, np.asarray(part["child"]) - 1 + first, -1)
        child[slot] = moved[0]
        feature[first:], threshold[first:] = part["feature"][1:], part["threshold"][1:]
        child[first:], path[first:] = moved[1:], part["path"][1:]
    return dict(zip(NODES, map(np.asarray, (feature, threshold, child, path)), strict=True))


def walk(points: np.ndarray, row: np.ndarray, node: np.ndarray, nodes: dict) -> np.ndarray:
    """The path length of ``row`` of the points from ``node`` on; points descend level by level."""
    feature, cut, child, path = (np.asarray(nodes[k]) for k in NODES)
    node = node.copy()
    active = np.arange(len(node))
    while len(active):
        at = node[active]
        inner = feature[at] >= 0
        active, at = active[inner], at[inner]
        node[active] = child[at] + (points[row[active], feature[at]] > cut[at])
    return path[node]


def path_sums(points: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Sum of the path lengths of every point."""
    total = np.zeros(len(points))
    every, top = np.arange(len(points)), np.zeros(len(points), np.int64)
    for tree in trees:
        total += walk(points, every, top, tree)
    return total


def anomaly_value(paths, trees: int, sample):
    """s(x) = 2^(-E[h(x)] / c(sample)) from the sum of the path lengths over ``trees`` trees."""
    return 2.0 ** (-(paths / max(trees, 1)) / np.maximum(c_factor(sample), 1e-12))


def feature_columns(df: DataFrame, config: dict) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """The input frame, feature names and expressions (NULLs not yet filled)."""
    df = with_time_features(df)
    exprs: dict[str, Column] = {}
    for name in config["features"]:
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType.typeName()
        if name == "day_of_week" and kind == "string":
            for day in WEEKDAYS:
                exprs[f"day_of_week_{day}"] = (F.col(name) == day).cast("double")
        elif kind not in ("string", "timestamp", "timestamp_ntz", "date", "boolean"):
            exprs[name] = F.col(name).cast("double")
    if "amount" in config["features"] and "amount" in df.columns:
        exprs.setdefault("amount_abs", F.abs("amount").cast("double"))
        exprs.setdefault("amount_log", F.log1p(F.abs("amount")).cast("double"))
    if not exprs:
        raise AnalysisError("Feature preparation failed")
    return df, list(exprs), exprs


def _features(df: DataFrame, config: dict) -> tuple[DataFrame, list[str], dict[str, Column]]:
    df, names, exprs = feature_columns(df, config)
    slim = df.select("id", "account_id", *[e.alias(f"_x{i}") for i, e in enumerate(exprs.values())])
    return slim, names, exprs


def _medians(slim: DataFrame, count: int, rows: int) -> list[float]:
    """Median per feature; only features that hold NULLs need one."""
    nulls = slim.agg(*[F.count_if(F.col(f"_x{i}").isNull()) for i in range(count)]).first()
    fills = [0.0] * count
    for i, n in enumerate(nulls):
        if n:
            fills[i] = global_quantiles(slim, f"_x{i}", {"m": 0.5}, rows).first()[0] or 0.0
    return fills


def _filled(slim: DataFrame, fills: list[float]) -> DataFrame:
    return slim.withColumns(
        {f"_x{i}": F.coalesce(F.col(f"_x{i}"), F.lit(float(v))) for i, v in enumerate(fills)}
    )


def sample_size(config: dict, rows: int) -> int:
    given = config["max_samples"]
    if given == "auto":
        return min(AUTO_SAMPLE, rows)
    if isinstance(given, float):
        return max(1, int(given * rows))
    return min(int(given), rows)


def _unit_hash(*parts: Column) -> Column:
    """Deterministic number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def drawn_trees(trees: int, seed: int, rate: Column) -> Column:
    """The trees that draw a row.

    ``rate`` is the expected share of rows a tree draws.  Below one row in
    ``trees`` a row is drawn once and given to one tree, so the hash work per
    row stays constant; otherwise every tree draws for itself.
    """
    ids = F.col("id")
    pool = rate * trees
    chosen = F.pmod(F.xxhash64(ids, F.lit(seed), F.lit("tree")), F.lit(trees)).cast("int")
    drawn = _unit_hash(ids, F.lit(seed), F.lit("pool")) < pool
    single = F.when(drawn, F.array(chosen)).otherwise(F.array().cast("array<int>"))
    each = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: (rate >= 1) | (_unit_hash(ids, F.lit(seed), t) < rate),
    )
    return F.when(pool < 1, single).otherwise(each)


def draw_order(seed: int, tree: Column) -> Column:
    """The order in which the rows a tree draws are taken, up to its sample."""
    return F.xxhash64(F.col("id"), F.lit(seed), tree, F.lit("order"))


def sample_rows(
    df: DataFrame, trees: int, seed: int, rate: Column, sample: Column, key: list[str], most: int
) -> DataFrame:
    """Rows of every tree: the ``sample`` smallest hashes of each (key, tree).

    ``most`` is the largest sample: one that no task may hold is never sorted as a whole.
    """
    picked = df.withColumn("tree", F.explode(drawn_trees(trees, seed, rate)))
    order = draw_order(seed, F.col("tree"))
    if most > group_rows(df.sparkSession):
        return _smallest(picked.withColumn("_order", order).withColumn("_take", sample.cast("long")), [*key, "tree"])
    rank = Window.partitionBy(*key, "tree").orderBy(order, "id")
    return picked.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= sample)


def _smallest(drawn: DataFrame, by: list[str]) -> DataFrame:
    """The ``_take`` rows of every group that come first by (``_order``, id).

    Counts of slices of the hash say in which slice the last of them lies; only its rows are ranked.
    """
    sliced = drawn.withColumn("_slice", F.shiftright("_order", 64 - SLICE_BITS))
    upto = Window.partitionBy(*by).orderBy("_slice")
    counts = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.first("_take").alias("_want"))
    edges = durable(
        counts.withColumn("_left", F.col("_want") - F.sum("_n").over(upto) + F.col("_n"))
        .filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_n")))
        .select(*by, F.col("_slice").alias("_edge"), "_left", "_n")
    )
    most = edges.agg(F.max("_n")).first()[0] or 0
    met = sliced.join(join_side(edges.drop("_n")), by, "left")
    last = met.filter(F.col("_slice") == F.col("_edge"))
    if most > group_rows(drawn.sparkSession):
        last = position_rows(last, by, ["_order", "id"], "_rank")
    else:
        last = last.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_order", "id")))
    # without an edge a group has no more rows than are wanted
    before = met.filter(F.col("_edge").isNull() | (F.col("_slice") < F.col("_edge")))
    return before.select(drawn.columns).unionByName(last.filter(F.col("_rank") <= F.col("_left")).select(drawn.columns))


def grow_forest(sampled: DataFrame, count: int, seed: int, key: list[str], sample: Column, most: int) -> DataFrame:
    """The trees in parts: (key, tree, root, nodes below root).

    A node with more rows than a task may hold is cut in Spark, all such nodes of a level in
    one aggregation, and makes a part of its own; smaller ones are grown in one Python group.
    Draws depend on (seed, key, tree, node) alone, so a tree is the same however it is cut up.
    """
    names = [f"_x{i}" for i in range(count)]
    bound = group_rows(sampled.sparkSession)
    salt = F.xxhash64(*key) if key else F.lit(0).cast("long")
    # the bits of sample - 1: the logarithm of sample, rounded up
    limit = F.length(F.bin(F.greatest(sample.cast("long"), F.lit(2)) - 1))
    points = sampled.select(
        *key,
        "tree",
        F.lit(1).cast("long").alias("node"),
        salt.alias("_salt"),
        limit.cast("int").alias("_limit"),
        *names,
    )
    tops = []
    if most > bound:
        points, tops = _cut_large(points, names, seed, key, bound)
    # samples of one key share a group as long as they are few rows
    bunch = F.floor(F.col("tree") / max(1, bound // max(most, 1))).cast("int") if key else F.col("tree")
    fields = f"{''.join(f'{k} string, ' for k in key)}{PART_FIELDS}"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order of points does not matter, that of roots only for the result's rows
        starts = pdf[["tree", "node"]].drop_duplicates().sort_values(["tree", "node"])
        at = pd.MultiIndex.from_frame(starts).get_indexer(pd.MultiIndex.from_frame(pdf[["tree", "node"]]))
        first = pdf.loc[starts.index]
        roots = Roots(*(first[c].to_numpy() for c in ("tree", "node", "_salt", "_limit")))
        grown = pd.DataFrame(grow_roots(pdf[names].to_numpy(float), at, roots, seed))
        kept = first[[*key, "tree", "node"]].rename(columns={"node": "root"}).reset_index(drop=True)
        return pd.concat([kept, grown], axis=1)

    by = [*key, "_bunch", *([] if most <= bound else ["node"])]
    forest = (
        points.withColumn("_bunch", bunch)
        .repartition(shuffle_partitions(sampled.sparkSession), *by)
        .groupBy(*by)
        .applyInPandas(grow, fields)
    )
    for top in tops:
        forest = forest.unionByName(top)
    return forest


def _cut_large(
    points: DataFrame, names: list[str], seed: int, key: list[str], bound: int
) -> tuple[DataFrame, list[DataFrame]]:
    """(rows of nodes with at most ``bound`` rows, parts of one node each for all above them)."""
    by = [*key, "tree", "node"]
    few, tops = [], []
    while True:
        points = durable(points)
        ends = [f(F.col(x)).alias(f"_{m}{x}") for x in names for m, f in (("lo", F.min), ("hi", F.max))]
        stats = durable(
            points.groupBy(*by).agg(
                F.count(F.lit(1)).alias("_n"), F.first("_salt").alias("_salt"), F.first("_limit").alias("_limit"), *ends
            )
        )
        large = stats.filter(F.col("_n") > bound)
        if large.isEmpty():
            few.append(points)
            break
        # there are at most rows / bound large nodes, small ones may be many
        few.append(points.join(join_side(large.select(*by)), by, "left_anti"))
        spans = F.array(
            *[
                F.when(
                    F.col(f"_hi{x}") > F.col(f"_lo{x}"),
                    F.struct(F.lit(i).alias("f"), F.col(f"_lo{x}").alias("lo"), F.col(f"_hi{x}").alias("hi")),
                )
                for i, x in enumerate(names)
            ]
        )
        depth = F.length(F.bin("node")) - 1
        chosen = large.withColumn("_usable", F.array_compact(spans)).withColumn("_depth", depth)
        kinds = F.size("_usable")
        nth = F.floor(node_draw_column(seed, 0) * kinds).cast("int")
        chosen = chosen.withColumn(
            "_cut", F.when(F.col("_depth") < F.col("_limit"), F.get("_usable", nth))
        )
        low, high = F.col("_cut.lo"), F.col("_cut.hi")
        drawn = low + node_draw_column(seed, 1) * (high - low)
        cuts = durable(
            chosen.select(
                *by,
                "_n",
                "_depth",
                F.col("_cut.f").alias("_f"),
                F.when(drawn < high, drawn).otherwise(low).alias("_t"),
            )
        )
        tops.append(_single_nodes(cuts, key))
        cut = join_side(cuts.filter("_f is not null").select(*by, "_f", "_t"))
        value = F.get(F.array(*names), F.col("_f"))
        points = (
            points.join(cut, by)
            .withColumn("node", 2 * F.col("node") + (value > F.col("_t")).cast("long"))
            .drop("_f", "_t")
        )
    rest = few[0]
    for other in few[1:]:
        rest = rest.unionByName(other)
    return rest, tops


def _single_nodes(cuts: DataFrame, key: list[str]) -> DataFrame:
    """Parts of one node: a cut that goes on below, or a leaf of many rows."""

    @F.pandas_udf(T.DoubleType())
    def leaf(depth: pd.Series, n: pd.Series) -> pd.Series:
        return depth + pd.Series(c_factor(n.to_numpy()))

    inner = F.col("_f").isNotNull()
    return cuts.select(
        *key,
        "tree",
        F.col("node").alias("root"),
        F.array(F.when(inner, F.col("_f")).otherwise(-1)).alias("feature"),
        F.array(F.when(inner, F.col("_t")).otherwise(0.0)).alias("threshold"),
        F.array(F.lit(-1)).alias("child"),
        F.array(F.when(inner, 0.0).otherwise(leaf("_depth", "_n"))).alias("path"),
    )


def normal_score(d: Column, low: Column, high: Column) -> Column:
    """D5d: invert and rescale to .01-.99; equal values give .1."""
    flat = F.coalesce(high - low, F.lit(0.0)) <= 0
    return F.when(flat, 0.1).otherwise(clamp(F.try_divide(high - d, high - low), 0.01, 0.99))


def confidence_of(d: Column, low: Column, high: Column) -> Column:
    """D5e: distance from the border, more for outliers."""
    largest = F.greatest(F.abs(low), F.abs(high))
    share = F.coalesce(F.try_divide(F.abs(d), largest), F.lit(0.0))
    return F.when(d < 0, clamp(share + 0.3, 0.1, 0.95)).otherwise(clamp(share + 0.1, 0.1, 0.9))


def _model_metadata(names: list[str], d: Column, level: str) -> dict[str, Column]:
    return {
        "analysis_level": F.lit(level),
        "reason": F.lit(None).cast("string"),
        "features_used": F.array(*[F.lit(n) for n in names]),
        "isolation_score": d,
        "is_outlier": d < 0,
    }


def _unfit(df: DataFrame, level: str, reason: str, confidence: float) -> DataFrame:
    metadata = {
        "analysis_level": F.lit(level),
        "reason": F.lit(reason),
        "features_used": F.lit(None).cast("array<string>"),
        "isolation_score": F.lit(None).cast("double"),
        "is_outlier": F.lit(None).cast("boolean"),
    }
    return scored(df, F.lit(0.1), F.lit(confidence), metadata)


class IsolationForestDetector(Detector):
    type = "ml_based"
    name = "isolation_forest"
    description = "Rows that few random cuts separate from all others"
    min_rows = 1
    default_config = {
        "contamination": 0.1,
        "n_estimators": 100,
        "max_samples": "auto",
        "features": ["amount", "hour", "day_of_week"],
        "account_specific": False,
        "min_samples_fit": 50,
        "random_state": 42,
    }

    def validate(self, config: dict) -> None:
        features, size = config["features"], config["max_samples"]
        require(isinstance(features, list) and bool(features), "features: a list of names")
        for name, least in (("n_estimators", 1), ("min_samples_fit", 10)):
            fine = isinstance(config[name], int) and config[name] >= least
            require(fine, f"{name}: a whole number from {least} on")
        share = config["contamination"]
        require(is_number(share) and 0 < share <= 0.5, "contamination: above 0, at most 0.5")
        if size == "auto":
            return
        require(is_number(size), "max_samples: 'auto', a share of the rows or a number of rows")
        top = 1 if isinstance(size, float) else float("inf")
        require(0 < size <= top, "max_samples: a share is at most 1, a number at least 1")

    def detect(self, txns: Transactions, config: dict) -> DataFrame:
        if config["account_specific"]:
            return self._per_account(txns, config)
        if txns.rows < config["min_samples_fit"]:
            return _unfit(txns.df, "global", "insufficient_data", 0.2)
        model, values = self._fit(txns, config)
        return self.score(model, txns.df, values)

    # -- one model for all rows ------------------------------------------------

    def fit(self, data: DataFrame | Transactions, config: dict | None = None) -> DataFrame:
        """D5f: the model as a table, one row per tree, with everything scoring needs."""
        txns = data if isinstance(data, Transactions) else Transactions(data)
        return self._fit(txns, self.merged(config))[0]

    def _fit(self, txns: Transactions, config: dict) -> tuple[DataFrame, DataFrame]:
        """The model and s(x) of the training rows."""
        rows = txns.rows
        if rows < config["min_samples_fit"]:
            raise AnalysisError("Insufficient data to fit Isolation Forest model")
        slim, names, _ = _features(txns.df, config)
        fills = _medians(slim, len(names), rows)
        slim = _filled(slim, fills)
        sample = sample_size(config, rows)
        trees, seed = config["n_estimators"], config["random_state"]
        rate = min(1.0, OVERSAMPLE * sample / rows)
        if rate * rows < sample + 30:
            rate = 1.0
        drawn = sample_rows(slim, trees, seed, F.lit(rate), F.lit(sample), [], sample)
        # stored once, read by every job
        forest = durable(grow_forest(drawn, len(names), seed, [], F.lit(sample), sample))
        values = durable(_score_values(spread_small(slim, rows), forest, len(names), sample))
        border = global_quantiles(
            values.withColumn("_minus", -F.col("_s")),
            "_minus",
            {"offset": float(config["contamination"])},
            rows,
        )
        ends = values.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
        facts = merge_rows(border, ends).first()
        model = forest.withColumns(
            {
                "features": F.array(*[F.lit(n) for n in names]),
                "requested": F.array(*[F.lit(n) for n in config["features"]]),
                "fills": F.array(*[F.lit(float(v)) for v in fills]),
                "sample": F.lit(sample),
                "offset": F.lit(facts["offset"]),
                "low": F.lit(-facts["_hi"] - facts["offset"]),
                "high": F.lit(-facts["_lo"] - facts["offset"]),
            }
        )
        return model, values

    def score(
        self,
        model: DataFrame,
        df: DataFrame,
        values: DataFrame | None = None,
        by_parts: bool | None = None,
    ) -> DataFrame:
        """Scores against a stored model; the range is that of the training rows.

        ``by_parts`` None: rows meet the parts of the forest where it is too large to broadcast.
        """
        facts = model.drop(*PART).first()
        config = {**self.default_config, "features": list(facts["requested"])}
        slim, names, _ = _features(df, config)
        if names != list(facts["features"]):
            raise AnalysisError("Feature dimension mismatch")
        if values is None:
            large = forest_nodes(model) > FOREST_NODES if by_parts is None else by_parts
            if df.isStreaming and large:
                raise AnalysisError("forest too large for a stateless stream: score its batches")
            filled = _filled(slim, list(facts["fills"]))
            values = _score_values(filled, model, len(names), facts["sample"], large)
        df = values.withColumn("_d", -F.col("_s") - F.lit(facts["offset"]))
        low, high = F.lit(facts["low"]), F.lit(facts["high"])
        d = F.col("_d")
        return scored(
            df,
            normal_score(d, low, high),
            confidence_of(d, low, high),
            _model_metadata(names, d, "global"),
        )

    # -- one model per account -------------------------------------------------

    def _per_account(self, txns: Transactions, config: dict) -> DataFrame:
        trees, seed = config["n_estimators"], config["random_state"]
        least = config["min_samples_fit"]
        slim, names, _ = _features(txns.df, config)
        count = len(names)
        by_account = Split.of(slim, "account_id", txns.hot)
        nulls = self._has_nulls(slim, count)
        # stays partitioned and sorted by account; growing is too much work for tasks put together by size
        spread = by_account.cold.repartition(shuffle_partitions(slim.sparkSession), "account_id")
        cold = self._counted(Split(spread), count, nulls)
        counted = cold
        values = _account_values(
            self._sampled(cold.filter(F.col("_n") >= least), config), count, trees, seed
        )
        if by_account.large is not None:
            hot = durable(self._counted(Split(slim.filter(F.lit(False)), by_account.large), count, nulls))
            large = self._sampled(hot.filter(F.col("_n") >= least), config)
            most = large.agg(F.max("_psi")).first()[0] or 0
            rate = F.col("_rate")
            drawn = sample_rows(large, trees, seed, rate, F.col("_psi"), ["account_id"], most)
            forest = durable(grow_forest(drawn, count, seed, ["account_id"], F.col("_psi"), most))
            values = values.unionByName(_score_by_parts(large, forest, count, trees, ["account_id"]))
            counted = cold.unionByName(hot)
        values = durable(values)
        facts = _account_facts(values, float(config["contamination"]), txns)
        scored_rows = facts.withColumn("_d", -F.col("_s") - F.col("_offset"))
        low = -F.col("_hi") - F.col("_offset")
        high = -F.col("_lo") - F.col("_offset")
        d = F.col("_d")
        good = scored(
            scored_rows,
            normal_score(d, low, high),
            confidence_of(d, low, high),
            _model_metadata(names, d, "account"),
        )
        small = counted.filter(F.col("_n") < least)
        return good.unionByName(_unfit(small, "account", "insufficient_account_data", 0.3))

    @staticmethod
    def _counted(rows: Split, count: int, nulls: bool) -> DataFrame:
        """The rows with ``_n``, those of their account, and NULLs filled by its medians."""
        counted = grouped_columns(
            rows,
            "account_id",
            [],
            aggregates={"_n": F.count(F.lit(1))},
            quantiles={f"_m{i}": (f"_x{i}", 0.5) for i in range(count)} if nulls else {},
        )
        if nulls:
            counted = counted.withColumns(
                {f"_x{i}": F.coalesce(f"_x{i}", f"_m{i}", F.lit(0.0)) for i in range(count)}
            )
        return counted.select("id", "account_id", "_n", *[f"_x{i}" for i in range(count)])

    @staticmethod
    def _sampled(counted: DataFrame, config: dict) -> DataFrame:
        """Adds ``_psi``, the sample of a tree, and ``_rate``, the share of the account it draws from."""
        size, n = config["max_samples"], F.col("_n")
        if size == "auto":
            sample = F.least(F.lit(AUTO_SAMPLE), n)
        elif isinstance(size, float):
            sample = F.greatest(F.lit(1), F.floor(n * size))
        else:
            sample = F.least(F.lit(size), n)
        counted = counted.withColumn("_psi", sample.cast("long"))
        want = OVERSAMPLE * F.col("_psi") / n
        return counted.withColumn("_rate", F.when(want * n < F.col("_psi") + 30, 1.0).otherwise(want))

    @staticmethod
    def _has_nulls(slim: DataFrame, count: int) -> bool:
        bad = F.lit(False)
        for i in range(count):
            bad = bad | F.col(f"_x{i}").isNull()
        return not slim.filter(bad).isEmpty()


def _account_values(rows: DataFrame, count: int, trees: int, seed: int) -> DataFrame:
    """``id``, ``account_id`` and s(x) of rows that lie together by account.

    An account that a task may hold draws its samples, grows its trees and walks them in one
    place.  Where a sample is less than the account, Spark names the trees that draw a row.
    """
    names = [f"_x{i}" for i in range(count)]
    drawn = F.when(F.col("_psi") < F.col("_n"), drawn_trees(trees, seed, F.col("_rate")))
    order = F.transform("_trees", lambda t: draw_order(seed, t))
    kept = ["id", "account_id"]
    lean = (
        rows.sortWithinPartitions("account_id")
        .withColumn("_trees", drawn)
        .select(*kept, "_n", "_psi", F.xxhash64("account_id").alias("_salt"), "_trees", order.alias("_order"), *names)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _whole_accounts(batches):
            found = account_values(table, sizes, names, trees, seed)
            columns = [table.column(c).combine_chunks() for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*kept, "_s"])

    return lean.mapInArrow(run, "id string, account_id string, _s double")


def _whole_accounts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole accounts, about ``ACCOUNT_ROWS`` rows or one account, and the rows of each."""
    held: list[pa.RecordBatch] = []
    waiting, wanted = 0, ACCOUNT_ROWS
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting < wanted:
            continue
        table = pa.Table.from_batches(held)
        n = table.column("_n").to_numpy()
        sizes, at, begin = [], 0, 0
        while at < len(n) and at + n[at] <= len(n):
            sizes.append(int(n[at]))
            at += sizes[-1]
            if at - begin >= ACCOUNT_ROWS:
                yield table.slice(begin, at - begin), np.array(sizes)
                sizes, begin = [], at
        if sizes:
            yield table.slice(begin, at - begin), np.array(sizes)
        held, waiting = table.slice(at).to_batches(), len(n) - at
        wanted = max(ACCOUNT_ROWS, int(n[at])) if waiting else ACCOUNT_ROWS
    if waiting:
        table = pa.Table.from_batches(held)
        n = table.column("_n").to_numpy()
        sizes, at = [], 0
        while at < len(n):
            sizes.append(int(n[at]))
            at += sizes[-1]
        yield table, np.array(sizes)


def account_values(table: pa.Table, sizes: np.ndarray, names: list[str], trees: int, seed: int) -> np.ndarray:
    """s(x) of every row; the rows of an account lie together."""
    points = np.column_stack([table.column(c).to_numpy() for c in names]).astype(float)
    begin = np.cumsum(sizes) - sizes
    psi, salt = (table.column(c).to_numpy()[begin] for c in ("_psi", "_salt"))
    accounts, rows = len(sizes), len(points)
    limit = np.array([int(max(p, 2) - 1).bit_length() for p in psi])
    of = np.repeat(np.arange(accounts), sizes)
    whole = np.flatnonzero((psi >= sizes)[of])
    lists = table.column("_trees").combine_chunks()
    # a row of an account larger than its samples stands for itself in every tree that draws it
    lengths = np.diff(lists.offsets.to_numpy()) if len(whole) < rows else np.zeros(rows, np.int64)
    drawer = np.repeat(np.arange(rows), lengths)
    tree = lists.flatten().to_numpy()
    order = table.column("_order").combine_chunks().flatten().to_numpy()
    paths = np.zeros(rows)
    step = max(1, ACCOUNT_POINTS // rows)
    for first in range(0, trees, step):
        some = np.arange(first, min(first + step, trees))
        mine = np.flatnonzero((tree >= first) & (tree < first + step))
        root = (tree[mine] - first) * accounts + of[drawer[mine]]
        sort = np.lexsort((order[mine], root))
        row, root = drawer[mine][sort], root[sort]
        rank = np.arange(len(root)) - np.searchsorted(root, root)
        taken = rank < psi[of[row]]
        row = np.append(row[taken], np.tile(whole, len(some)))
        root = np.append(root[taken], np.repeat(np.arange(len(some)) * accounts, len(whole)) + np.tile(of[whole], len(some)))
        # rows that all repeat an id may leave a tree without any
        grown, at = np.unique(root, return_inverse=True)
        account = grown % accounts
        roots = Roots(some[grown // accounts], np.ones(len(grown), np.int64), salt[account], limit[account])
        _, nodes = grow_nodes(points[row], at, roots, seed)
        top = np.full(len(some) * accounts, -1)
        top[grown] = np.arange(len(grown))
        for k in range(len(some)):
            start = top[k * accounts + of]
            walked = np.flatnonzero(start >= 0)
            paths[walked] += walk(points, walked, start[walked], nodes)
    return anomaly_value(paths, trees, psi[of])


def _account_facts(values: DataFrame, contamination: float, txns: Transactions) -> DataFrame:
    marked = values.withColumn("_minus", -F.col("_s"))
    return grouped_columns(
        marked,
        "account_id",
        [],
        aggregates={"_lo": F.min("_s"), "_hi": F.max("_s")},
        quantiles={"_offset": ("_minus", contamination)},
        hot=txns.hot,
    )


def forest_nodes(forest: DataFrame) -> int:
    return forest.agg(F.sum(F.size("feature"))).first()[0] or 0


def _score_values(
    slim: DataFrame, forest: DataFrame, count: int, sample: int, by_parts: bool | None = None
) -> DataFrame:
    """``id`` and s(x).  A forest of up to ``FOREST_NODES`` nodes travels to the executors as
    one broadcast; the rows of a larger one meet its parts."""
    names = [f"_x{i}" for i in range(count)]
    if forest_nodes(forest) > FOREST_NODES if by_parts is None else by_parts:
        trees = forest.agg(F.count_distinct("tree")).first()[0]
        rows = slim.select("id", *names, F.lit(sample).cast("long").alias("_psi"))
        return _score_by_parts(rows, forest, count, trees, [])
    parts: dict[int, dict] = {}
    for r in forest.select(*PART).collect():
        parts.setdefault(r["tree"], {})[r["root"]] = {k: np.asarray(r[k]) for k in NODES}
    trees = [whole_tree(parts[t]) for t in sorted(parts)]
    shared = slim.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf(T.DoubleType())
    def value(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(anomaly_value(path_sums(points, shared.value), len(shared.value), sample))

    return slim.select("id", value(*[F.col(x) for x in names]).alias("_s"))


def _score_by_parts(rows: DataFrame, forest: DataFrame, count: int, trees: int, key: list[str]) -> DataFrame:
    """``id``, the key and s(x), by a forest of any size, or one forest for each key.

    ``rows`` has the sample size ``_psi``.  Trees are packed into bundles of up to
    ``FOREST_NODES`` nodes.  Rows are copied to every bundle of their key; in a tree too
    large for a bundle they go down through its single nodes to the part they end in.  Rows
    and bundles meet in blocks of bounded size, and path lengths are summed for each row.
    """
    names = [f"_x{i}" for i in range(count)]
    spark = rows.sparkSession
    sizes = forest.groupBy(*key, "tree").agg(F.sum(F.size("feature")).alias("_nodes"))
    fits = F.col("_nodes") <= FOREST_NODES
    before = Window.partitionBy(*key).orderBy("tree")
    # one row for each tree of a key
    packed = durable(
        sizes.filter(fits).withColumn("_bundle", F.floor(F.sum("_nodes").over(before) / FOREST_NODES).cast("int"))
    )
    # rows that repeat an id are scored each
    rows = durable(rows.select("id", *key, "_psi", *names).withColumn("_row", F.monotonically_increasing_id()))
    bundle = [F.lit(-1).alias("tree"), F.col("_bundle").cast("long").alias("root")]
    large = sizes.filter(~fits).select(*key, "tree")
    deep = not large.isEmpty()
    if key:
        copies = rows.join(join_side(packed.select(*key, *bundle).distinct()), key)
    else:
        last = packed.agg(F.max("_bundle")).first()[0]
        every = [F.lit(b).cast("long") for b in range(0 if last is None else last + 1)]
        copies = rows.withColumns({"tree": F.lit(-1), "root": F.explode(F.array(*every).cast("array<long>"))})
    where = [*key, "tree", "root"]
    own = [F.col("tree").alias("_tree"), F.col("root").alias("_root"), *NODES]
    with_bundle = forest.join(packed.drop("_nodes"), [*key, "tree"])
    parts = with_bundle.select(*key, *bundle, *own)
    if deep:
        of_large = forest.join(join_side(large), [*key, "tree"])
        routed, ends = _descend(rows, of_large, large, names, key)
        copies = copies.unionByName(routed.select(copies.columns))
        parts = parts.unionByName(ends.select(*where, *own))
    share = copies.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / SCORE_BLOCK).cast("int").alias("_blocks"))
    blocks = durable(share)
    spread = copies.join(join_side(blocks), where)
    left = spread.withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    right = parts.join(blocks, where).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    fields = [*key, "id", "_row", "_psi"]

    def walk(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, dict] = {}
        for part in parts.to_dict("records"):
            # a part below the top stands for itself
            found.setdefault(part["_tree"], {})[part["_root"]] = {k: np.asarray(part[k]) for k in NODES}
        trees = [whole_tree(t) if 1 in t else next(iter(t.values())) for _, t in sorted(found.items())]
        return rows[fields].assign(_paths=path_sums(rows[names].to_numpy(float), trees))

    meet = [*where, "_block"]
    parts_ = shuffle_partitions(spark)
    walked = (
        left.select(*meet, "id", "_row", "_psi", *names)
        .repartition(parts_, *meet)
        .groupBy(*meet)
        .cogroup(right.select(*meet, "_tree", "_root", *NODES).repartition(parts_, *meet).groupBy(*meet))
        .applyInPandas(
            walk, f"{''.join(f'{k} string, ' for k in key)}id string, _row long, _psi long, _paths double"
        )
    )
    if deep or not packed.filter("_bundle > 0").isEmpty():
        walked = walked.groupBy("_row").agg(
            F.first("id").alias("id"),
            *[F.first(k).alias(k) for k in key],
            F.first("_psi").alias("_psi"),
            F.sum("_paths").alias("_paths"),
        )

    @F.pandas_udf(T.DoubleType())
    def value(paths: pd.Series, sample: pd.Series) -> pd.Series:
        return pd.Series(anomaly_value(paths.to_numpy(), trees, sample.to_numpy()))

    return walked.select("id", *key, value("_paths", "_psi").alias("_s"))


def _descend(
    rows: DataFrame, forest: DataFrame, large: DataFrame, names: list[str], key: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(a row for each row and large tree with the part it ends in, those parts).

    Cuts that go on in other parts are applied a level at a time, as when the tree was grown.
    """
    goes_on = (F.size("feature") == 1) & (F.col("feature")[0] >= 0)
    tops = forest.filter(goes_on).select(
        *key, "tree", "root", F.col("feature")[0].alias("_f"), F.col("threshold")[0].alias("_t")
    )
    if not key and tops.count() <= FOREST_NODES:
        return _to_parts(rows, tops, large, names), forest.filter(~goes_on)
    tops = join_side(tops)
    levels = tops.agg(F.max(F.length(F.bin("root")))).first()[0] or 0
    if key:
        at = rows.join(join_side(large), key)
    else:
        # no more than the trees of one forest
        trees = F.array(*[F.lit(r["tree"]) for r in large.orderBy("tree").collect()])
        at = rows.withColumn("tree", F.explode(trees))
    at = at.withColumn("root", F.lit(1).cast("long"))
    value = F.get(F.array(*names), F.col("_f"))
    step = 2 * F.col("root") + (value > F.col("_t")).cast("long")
    for level in range(levels):
        at = at.join(tops, [*key, "tree", "root"], "left").withColumn(
            "root", F.when(F.col("_f").isNotNull(), step).otherwise(F.col("root"))
        ).drop("_f", "_t")
        if level % 8 == 7:
            at = durable(at)
    return at, forest.filter(~goes_on)


def _to_parts(rows: DataFrame, tops: DataFrame, large: DataFrame, names: list[str]) -> DataFrame:
    """``_descend`` by a broadcast of the cuts at the top, all trees of a row at once."""
    trees = [r["tree"] for r in large.orderBy("tree").collect()]
    cuts: dict[int, list] = {t: [] for t in trees}
    for r in tops.orderBy("root").collect():
        cuts[r["tree"]].append((r["root"], r["_f"], r["_t"]))
    kinds = (np.int64, np.int64, float)
    packed = [tuple(np.array([c[i] for c in cuts[t]], kind) for i, kind in enumerate(kinds)) for t in trees]
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def roots_of(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(float) for c in columns])
        out = np.ones((len(points), len(shared.value)), np.int64)
        for j, (root, feature, threshold) in enumerate(shared.value):
            node, active = out[:, j], np.arange(len(points))
            # a large tree that one task grew has no cuts at the top
            while len(active) and len(root):
                at = np.minimum(np.searchsorted(root, node[active]), len(root) - 1)
                inner = root[at] == node[active]
                active, at = active[inner], at[inner]
                node[active] = 2 * node[active] + (points[active, feature[at]] > threshold[at])
        return pd.Series(list(out))

    ends = F.arrays_zip(F.array(*[F.lit(t) for t in trees]).alias("tree"), F.col("_roots").alias("root"))
    found = rows.withColumn("_roots", roots_of(*[F.col(x) for x in names]))
    return found.withColumn("_end", F.explode(ends)).select(*rows.columns, "_end.tree", "_end.root")


register(IsolationForestDetector())
