"""Per-key work that stays balanced when one key holds a large share of all rows.

A key is *hot* when it holds more rows than one task should: more than
``spark.oddledger.groupRows``, whatever the size of the table.  Cold keys use ordinary
windows; hot keys are range-partitioned on (key, order), numbered, and cut into blocks.
The table of hot keys and what is derived from it are stored and counted, and broadcast
only up to ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oddledger.session import durable, group_rows, shuffle_partitions

_ALL = "_all"
BROADCAST_ROWS = 200_000


def join_side(side: DataFrame) -> DataFrame:
    """A stored side of a join: broadcast up to ``BROADCAST_ROWS`` rows, else shuffled."""
    side = durable(side)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


POSITION = "_position"


@dataclass
class HotKeys:
    """Keys too large for one task; ``table`` is None when there are none."""

    key: str
    table: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.table is not None

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of cold keys, rows of hot keys)."""
        return df.join(self.table, self.key, "left_anti"), df.join(
            self.table, self.key, "left_semi"
        )


@dataclass
class Split:
    """Rows of cold keys, already partitioned by the key, and rows of hot keys.

    Several detectors that start from the same split share its one exchange.
    Hot rows may come numbered already, in the order the windows will use.
    """

    cold: DataFrame
    large: DataFrame | None = None

    @staticmethod
    def of(df: DataFrame, key: str, hot: HotKeys) -> Split:
        if not hot:
            return Split(df.repartition(key))
        cold, large = hot.split(df)
        return Split(cold.repartition(key), large)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Split:
        """The same row-wise change on both sides."""
        return Split(change(self.cold), None if self.large is None else change(self.large))


def hot_keys(df: DataFrame, key: str) -> HotKeys:
    """Find the hot keys: one map-side combined count over the key column alone."""
    return key_facts(df, key)[1]


def key_facts(df: DataFrame, key: str) -> tuple[int, HotKeys]:
    """Number of rows and the hot keys."""
    limit = group_rows(df.sparkSession)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    if not total or largest <= limit:
        return total or 0, HotKeys(key)
    return total, HotKeys(key, join_side(counts.filter(F.col("n") > limit).select(key)))


def position_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 1 in the given order, on all tasks at once.

    The sort is a range exchange over (keys, order): ties beyond the order
    columns may be numbered either way, but a key or a repeated value never
    ends up in a single task unless the whole sort tuple repeats.
    """
    parts = shuffle_partitions(df.sparkSession)
    sort = [*keys, *order]
    numbered = durable(
        df.repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    spans = _offsets(
        numbered.groupBy(*keys, "_part").agg(
            F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
        ),
        keys,
    )
    return (
        numbered.join(join_side(spans), [*keys, "_part"])
        .withColumn(out, F.col("_mid") - F.col("_first") + F.col("_before") + 1)
        .drop("_mid", "_part", "_first", "_n", "_before", "_total")
    )


def _offsets(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same key in earlier partitions; one row per key and partition."""
    ahead = Window.partitionBy(*keys).orderBy("_part")
    return spans.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))


def spread_blocks(df: DataFrame, position: str, size: int, before: int, after: int) -> DataFrame:
    """Cut numbered rows into blocks of ``size`` and copy the edge rows the
    neighbouring block needs.  Adds ``_block`` and ``_own`` (False for copies)."""
    at = (F.col(position) - 1) % size
    home = F.floor((F.col(position) - 1) / size)
    places = [home]
    if before:
        places.append(F.when(at >= size - before, home + 1))
    if after:
        places.append(F.when((at < after) & (home > 0), home - 1))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(F.array_compact(F.array(*places))))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )


def block_size(df: DataFrame, before: int, after: int) -> int:
    return max(group_rows(df.sparkSession), 2 * (before + after + 1))


def grouped_columns(
    df: DataFrame | Split,
    key: str,
    order: list[str],
    ordered: dict[str, Callable[[WindowSpec], Column]] | None = None,
    before: int = 0,
    after: int = 0,
    sequence: str | None = None,
    aggregates: dict[str, Column] | None = None,
    quantiles: dict[str, tuple[str, float]] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add per-key columns to every row.

    ``ordered`` maps a name to a function of the ordered window; its frames may
    reach at most ``before`` / ``after`` rows.  ``sequence`` names a 1-based row
    number.  ``aggregates`` and ``quantiles`` (column, p) cover the whole key and
    may use the ordered columns.  Cold keys need one exchange for all of it.
    Give a ``Split`` to share that exchange with other calls.
    """
    ordered, aggregates, quantiles = ordered or {}, aggregates or {}, quantiles or {}
    if not isinstance(df, Split):
        df = Split.of(df, key, hot_keys(df, key) if hot is None else hot)
    cold, large = df.cold, df.large
    window = Window.partitionBy(key).orderBy(*order)
    steps = {name: make(window) for name, make in ordered.items()}
    if sequence:
        steps[sequence] = F.row_number().over(window).cast("long")
    whole = Window.partitionBy(key)
    totals = {name: agg.over(whole) for name, agg in aggregates.items()}
    for name, (value, p) in quantiles.items():
        totals[name] = F.percentile(value, F.lit(float(p))).over(whole)
    result = cold.withColumns(steps) if steps else cold
    result = result.withColumns(totals) if totals else result
    if large is None:
        return result
    done = large
    if steps:
        if POSITION not in large.columns:
            large = position_rows(large, [key], order, POSITION)
        size = block_size(large, before, after)
        blocks = spread_blocks(large, POSITION, size, before, after)
        window = Window.partitionBy(key, "_block").orderBy(POSITION)
        done = blocks.withColumns({name: make(window) for name, make in ordered.items()})
        done = done.filter("_own").drop("_block", "_own")
        if sequence:
            done = done.withColumn(sequence, F.col(POSITION))
    if totals:
        stats = key_table(done, key, aggregates, quantiles)
        done = done.join(join_side(stats), key, "left")
    return result.unionByName(done.select(result.columns))


def ordered_columns(df, key, order, columns, before=0, after=0, sequence=None, hot=None):
    """``grouped_columns`` with ordered frames only."""
    return grouped_columns(df, key, order, columns, before, after, sequence, hot=hot)


def global_ordered_columns(
    df: DataFrame,
    order: list[str],
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Frames over the order of *all* rows, without a single-task window."""
    numbered = position_rows(df.withColumn(_ALL, F.lit(1)), [_ALL], order, "_pos")
    spread = max(2 * (before + after + 1), 1 + group_rows(df.sparkSession) // 10)
    blocks = spread_blocks(numbered, "_pos", spread, before, after)
    window = Window.partitionBy("_block").orderBy("_pos")
    done = blocks.withColumns({name: make(window) for name, make in columns.items()})
    return done.filter("_own").drop(_ALL, "_block", "_own", "_pos")


def key_columns(df, key, aggregates, quantiles=None, hot=None):
    """``grouped_columns`` with whole-key values only."""
    return grouped_columns(df, key, [], aggregates=aggregates, quantiles=quantiles, hot=hot)


def key_table(
    df: DataFrame,
    key: str,
    aggregates: dict[str, Column],
    quantiles: dict[str, tuple[str, float]],
) -> DataFrame:
    """One row per key; quantiles come from a distributed sort."""
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), *[agg.alias(name) for name, agg in aggregates.items()]
    )
    by_value: dict[str, dict[str, float]] = {}
    for name, (value, p) in quantiles.items():
        by_value.setdefault(value, {})[name] = p
    for value, probs in by_value.items():
        stats = stats.join(sorted_quantiles(df, [key], value, probs), key, "left")
    return stats.drop("_rows")


def sorted_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear quantiles by a distributed sort of the distinct values.

    Equal values are counted before the exchange, so a value that fills a third
    of the table is one row; the sorted values are spread over all tasks.
    """
    parts = shuffle_partitions(df.sparkSession)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranged = durable(
        counted.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id())
    )
    spans = _offsets(ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n")), keys)
    running = Window.partitionBy(*keys, "_part").orderBy("_v")
    placed = (
        ranged.withColumn(
            "_run", F.sum("_c").over(running.rowsBetween(Window.unboundedPreceding, 0))
        )
        .join(join_side(spans), [*keys, "_part"])
        .withColumn("_upto", F.col("_before") + F.col("_run"))
        .withColumn("_from", F.col("_upto") - F.col("_c"))
    )
    picks = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_from") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}_{name}"))
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    columns = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        mixed = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        columns.append(F.when(F.floor(at) == F.ceil(at), lo).otherwise(mixed).alias(name))
    return found.select(*keys, *columns)


def global_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], rows: int | None = None
) -> DataFrame:
    """Exact quantiles of one column as a single row.

    Up to ``groupRows`` rows one aggregate holds all values; beyond that the
    values are sorted over all tasks.
    """
    if rows is None:
        rows = df.count()
    if rows <= group_rows(df.sparkSession):
        return df.agg(
            *[F.percentile(value, F.lit(float(p))).alias(name) for name, p in probs.items()]
        )
    found = sorted_quantiles(df.withColumn(_ALL, F.lit(1)), [_ALL], value, probs)
    # an aggregate returns its row even when no value is left
    return found.agg(*[F.max(name).alias(name) for name in probs])


def table_stats(
    df: DataFrame,
    aggregates: dict[str, Column],
    quantiles: dict[str, tuple[str, float]],
    rows: int | None = None,
) -> DataFrame:
    """One row of aggregates and exact quantiles ``name: (column, p)``.

    Up to ``groupRows`` rows all of it is one aggregation; beyond that the values of all
    quantile columns are sorted over all tasks together.
    """
    rows = df.count() if rows is None else rows
    plain = [agg.alias(name) for name, agg in aggregates.items()]
    if rows <= group_rows(df.sparkSession):
        by_value: dict[str, list[str]] = {}
        for name, (value, _) in quantiles.items():
            by_value.setdefault(value, []).append(name)
        arrays, picks = [], []
        for i, (value, names) in enumerate(by_value.items()):
            probs = F.array(*[F.lit(float(quantiles[n][1])) for n in names])
            arrays.append(F.percentile(f"`{value}`", probs).alias(f"_q{i}"))
            picks += [F.col(f"_q{i}")[k].alias(n) for k, n in enumerate(names)]
        return df.agg(*plain, *arrays).select(*aggregates, *picks)
    parts = [df.agg(*plain)] if plain else []
    if quantiles:
        # all columns in one exchange, a row for each value
        values = sorted({value for value, _ in quantiles.values()})
        cells = [
            F.struct(F.lit(i).alias("_number"), F.col(f"`{value}`").cast("double").alias("_number_value"))
            for i, value in enumerate(values)
        ]
        long = df.select(F.explode(F.array(*cells)).alias("_cell")).select("_cell.*")
        found = sorted_quantiles(long, ["_number"], "_number_value", {name: p for name, (_, p) in quantiles.items()})
        own = {name: F.col("_number") == values.index(value) for name, (value, _) in quantiles.items()}
        parts.append(found.agg(*[F.max(F.when(own[name], F.col(name))).alias(name) for name in quantiles]))
    return merge_rows(*parts)


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct column (scalar subquery, no join)."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def merge_rows(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row DataFrames side by side."""
    first, *rest = frames
    for other in rest:
        packed = one_row(other)
        first = first.withColumns({name: packed.getField(name) for name in other.columns})
    return first

