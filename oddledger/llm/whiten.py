"""Whitening of vectors by polarisation covariance.

Entries become whole numbers.  For every dimension, and for the sum of every pair of
dimensions, the squares of the centred values are added up exactly; the variances of a pair's
sum and of its parts give the covariance.  The matrix, whose size is that of one vector
squared, is taken apart on the driver, and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddledger.session import staged

ROWS = 1 << 11
SAFE = 1 << 62
# entries beyond this are taken as this, so that a whole number stays exact in a double
MOST = float(1 << 53)
EXACT = pa.decimal128(38, 0)
EXACT_MOST = 10**38 - 1


@dataclass(frozen=True)
class Whitening:
    """An entry c becomes floor(``scale`` * c) + ``offset``."""

    components: int = 8
    scale: float = 1024.0
    offset: int = 100_000


@dataclass(frozen=True)
class Fit:
    """``n`` vectors of ``size`` entries, their sums, and the components by falling eigenvalue.

    ``centre`` is the whole part of the mean and ``rest`` = sums - n * centre, 0 <= rest < n.
    """

    size: int
    n: int
    centre: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def scaled(self) -> np.ndarray:
        """Projection to components of variance 1; one without variance gives 0."""
        flat = self.values <= self.flat()
        return np.where(flat, 0.0, self.vectors / np.sqrt(np.where(flat, 1.0, self.values)))

    def flat(self) -> float:
        """Eigenvalues up to this are rounding only."""
        return float(max(self.trace, 0.0)) * np.finfo(float).eps * max(self.size, 1)


def whole_numbers(column: pa.Array, p: Whitening, size: int | None = None):
    """(rows, lengths, values): the usable rows of a list column and their entries in a row.

    Null lists, empty lists and lists with a null or non-finite entry are left out, and with
    ``size`` those of another length.
    """
    column = column.cast(pa.large_list(pa.float64()))
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    lengths = np.diff(at)
    good = pc.is_valid(column).to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (lengths > 0)
    if size is not None:
        good &= lengths == size
    rows = np.flatnonzero(good)
    taken = np.repeat(at[:-1][rows] - np.cumsum(lengths[rows]) + lengths[rows], lengths[rows])
    entries = flat[taken + np.arange(len(taken))]
    with np.errstate(over="ignore"):
        steps = np.clip(np.floor(entries * p.scale), -MOST, MOST)
    return rows, lengths[rows], steps.astype(np.int64) + p.offset


def _matrix(column: pa.Array, p: Whitening, fit_size: int, centre: list[int]) -> tuple[np.ndarray, np.ndarray]:
    rows, _, x = whole_numbers(column, p, fit_size)
    return rows, x.reshape(-1, fit_size) - np.array(centre, np.int64)


def _largest(values: np.ndarray) -> int:
    return max(-int(values.min()), int(values.max())) if values.size else 0


def column_sums(values: np.ndarray) -> np.ndarray:
    """Exact column sums as Python integers."""
    if _largest(values) * max(len(values), 1) >= SAFE:
        values = values.astype(object)
    return values.sum(axis=0).astype(object)


def square_sums(values: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of every column and of every sum of two columns.

    In the order (0, 0), (0, 1), ... (0, d-1), (1, 1), ...: the square of a column alone
    stands where a pair would name it twice.
    """
    n, d = values.shape
    if 4 * _largest(values) ** 2 * max(n, 1) >= SAFE:
        values = values.astype(object)
    out = []
    for i in range(d):
        both = values[:, i:] + values[:, i : i + 1]
        both[:, 0] = values[:, i]
        out.append((both * both).sum(axis=0).astype(object))
    return np.concatenate(out)


def _decimals(values: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def _sums(rows: DataFrame, p: Whitening) -> DataFrame:
    """(size, dim, n, total): number and sums of the vectors of every length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            _, lengths, x = whole_numbers(batch.column(0), p)
            begin = np.cumsum(lengths) - lengths
            for size in np.unique(lengths).tolist():
                own = begin[lengths == size]
                part = x[own[:, None] + np.arange(size)]
                n, total = held.get(size, (0, np.zeros(size, object)))
                held[size] = (n + len(part), total + column_sums(part))
        for size, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, size, np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array(np.full(size, n, np.int64)),
                    _decimals(total),
                ],
                ["size", "dim", "n", "total"],
            )

    found = rows.mapInArrow(run, "size int, dim int, n long, total decimal(38,0)")
    return found.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _squares(rows: DataFrame, p: Whitening, size: int, centre: list[int]) -> DataFrame:
    """(spot, total): ``square_sums`` of all centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, u = _matrix(batch.column(0), p, size, centre)
            for low in range(0, len(u), ROWS):
                part = square_sums(u[low : low + ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), _decimals(total)], ["spot", "total"]
            )

    found = rows.mapInArrow(run, "spot int, total decimal(38,0)")
    return found.groupBy("spot").agg(F.sum("total").alias("total"))


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Covariances, divisor ``n``, each rounded once.

    The centred values are u - rest / n; ``squares`` are those of u in ``square_sums`` order,
    and n * squares - rest**2 is n**2 times the variance, exactly.
    """
    d = len(rest)
    spread: dict[tuple[int, int], int] = {}
    spot = 0
    for i in range(d):
        for j in range(i, d):
            r = rest[i] if i == j else rest[i] + rest[j]
            spread[i, j] = n * squares[spot] - r * r
            spot += 1
    out = np.empty((d, d))
    for (i, j), both in spread.items():
        if i == j:
            out[i, i] = both / (n * n)
        else:
            out[i, j] = out[j, i] = (both - spread[i, i] - spread[j, j]) / (2 * n * n)
    return out


def fit(rows: DataFrame, p: Whitening | None = None) -> Fit | None:
    """Components of the vectors in the one column of ``rows``; None without a usable vector.

    Vectors of the commonest length are used, the longer ones on a tie.  The driver gets the
    sums of one vector's dimensions and dimension pairs, whatever the number of rows.
    """
    p = p or Whitening()
    sums = staged(_sums(rows, p), "sums")
    best = sums.filter("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    size, n = best["size"], best["n"]
    total = [int(r["total"]) for r in sums.filter(F.col("size") == size).orderBy("dim").collect()]
    centre = [t // n for t in total]
    rest = [t - n * c for t, c in zip(total, centre, strict=True)]
    squares = _squares(rows, p, size, centre).orderBy("spot").collect()
    v = covariance(n, rest, [int(r["total"]) for r in squares])
    values, vectors = np.linalg.eigh(v)
    k = min(p.components, size)
    return Fit(
        size, n, centre, rest, vectors[:, ::-1][:, :k], values[::-1][:k].copy(), float(np.trace(v))
    )


def _projected(u: np.ndarray, model: Fit, scaled: np.ndarray) -> np.ndarray:
    return (u - np.array([r / model.n for r in model.rest])) @ scaled


def identity_error(rows: DataFrame, model: Fit, p: Whitening | None = None) -> float:
    """Largest entry of |covariance of the whitened rows - identity|, from the rows themselves.

    Components without variance are left out; without any other it is 0.
    """
    p = p or Whitening()
    scaled = model.scaled()
    k = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, u = _matrix(batch.column(0), p, model.size, model.centre)
            w = _projected(u, model, scaled)
            first += w.sum(axis=0)
            second += w.T @ w
        found = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["spot", "total"]
        )

    found = rows.mapInArrow(run, "spot int, total double").groupBy("spot").agg(F.sum("total").alias("total"))
    total = np.array([r["total"] for r in found.orderBy("spot").collect()]) / model.n
    mean, second = total[:k], total[k:].reshape(k, k)
    live = model.values > model.flat()
    off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    return float(off.max()) if off.size else 0.0


def deviations(u: np.ndarray, model: Fit) -> pa.Array:
    """Sum over the dimensions of (n * x - sums)**2, exact; null beyond 38 digits."""
    rest = np.array(model.rest, object)
    if len(u) and model.size * (model.n * (_largest(u) + 1)) ** 2 < SAFE:
        far = u * model.n - rest.astype(np.int64)
        return pa.array((far * far).sum(axis=1)).cast(EXACT)
    far = u.astype(object) * model.n - rest
    total = [int(v) for v in (far * far).sum(axis=1)]
    return pa.array([Decimal(v) if v <= EXACT_MOST else None for v in total], EXACT)


OUT = (
    "component int, n long, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


def whiten(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", p: Whitening | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row.

    A row gives one row for each component, numbered from 1 by falling eigenvalue.  Rows whose
    vector is null, empty, holds a null or non-finite entry, or has another length than most,
    are left out.  Repeated rows and rows without id are kept.  A component without variance
    has whitened and explained 0.  Entries of more than 2**53 steps are taken as 2**53, and a
    deviation of more than 38 digits is null.  Without a usable row the result is empty.
    Other columns are left aside.
    """
    p = p or Whitening()
    spark = table.sparkSession
    kind = table.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, {OUT}"
    rows = table.select(F.col(id_), F.col(vector))
    model = fit(rows.select(vector), p)
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(rows.select(vector), model, p)
    scaled, k = model.scaled(), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
    explained = np.where(model.values > model.flat(), explained, 0.0)
    names = [id_, *(c.split()[0] for c in OUT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used, u = _matrix(batch.column(1), p, model.size, model.centre)
            w = _projected(u, model, scaled)
            each = np.repeat(np.arange(len(used)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(used[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(used))),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    deviations(u, model).take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(used))),
                    pa.array(np.full(len(each), error)),
                ],
                names,
            )

    return rows.mapInArrow(run, schema)
