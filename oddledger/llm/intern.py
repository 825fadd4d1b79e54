"""Interning of byte runs: an open-addressed NumPy table keyed by xxhash64.

All runs of a batch probe the table together.  A run whose slot is empty claims it; a run that
meets another one there is told apart by its bytes and moves on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

# fixed values of xxHash64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(v)
    for v in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)
# runs of this many bytes and more are hashed and compared one at a time
LONG = 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _view(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian number that begins at each byte."""
    width = np.dtype(kind).itemsize
    return np.ndarray(len(data) - width + 1, kind, data, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxHash64, seed 0, of every run; ``data`` has 8 bytes behind the last run."""
    eight, four = _view(data, "<u8"), _view(data, "<u4")
    h = lengths.astype(np.uint64) + _P5
    for j in range(LONG // 8 - 1):
        at = np.flatnonzero((lengths >= 8 * (j + 1)) & (lengths < LONG))
        if not len(at):
            break
        h[at] = _turn(h[at] ^ _turn(eight[starts[at] + 8 * j] * _P2, 31) * _P1, 27) * _P1 + _P4
    at = np.flatnonzero((lengths & 4 > 0) & (lengths < LONG))
    spot = starts[at] + (lengths[at] & ~7)
    h[at] = _turn(h[at] ^ four[spot].astype(np.uint64) * _P1, 23) * _P2 + _P3
    for j in range(3):
        at = np.flatnonzero((lengths & 3 > j) & (lengths < LONG))
        spot = starts[at] + (lengths[at] & ~3) + j
        h[at] = _turn(h[at] ^ data[spot].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lengths >= LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the runs that begin at ``a`` and ``b`` have the same bytes."""
    eight = _view(data, "<u8")
    out = np.ones(len(a), bool)
    for j in range(LONG // 8):
        at = np.flatnonzero((lengths > 8 * j) & (lengths < LONG))
        if not len(at):
            break
        differ = eight[a[at] + 8 * j] ^ eight[b[at] + 8 * j]
        out[at] &= differ & _MASK[np.minimum(lengths[at] - 8 * j, 8)] == 0
    for i in np.flatnonzero((lengths >= LONG) & (a != b)).tolist():
        n = lengths[i]
        out[i] = np.array_equal(data[a[i] : a[i] + n], data[b[i] : b[i] + n])
    return out


@dataclass
class Table:
    """``owner`` holds for each slot the run that claimed it, -1 where the slot is free."""

    owner: np.ndarray
    count: np.ndarray
    bucket: np.ndarray
    slots: np.ndarray


def intern(
    data: np.ndarray,
    starts: np.ndarray,
    lengths: np.ndarray,
    bucket_of,
    hashed: np.ndarray | None = None,
) -> Table:
    """Give equal runs one slot; ``slots`` is the slot of every run.

    ``bucket_of`` maps the bytes of a run to its bucket and is asked once a slot.  ``hashed``
    stands in for the hashes, for tests.
    """
    n = len(starts)
    h = hashes(data, starts, lengths) if hashed is None else hashed
    size = 1 << max(4, (2 * n - 1).bit_length())
    owner = np.full(size, -1, np.int64)
    slots = (h & np.uint64(size - 1)).astype(np.int64)
    open_ = np.arange(n)
    while len(open_):
        at = slots[open_]
        free = owner[at] < 0
        owner[at[free]] = open_[free]
        other = owner[at]
        met = (h[other] == h[open_]) & (lengths[other] == lengths[open_])
        near = np.flatnonzero(met)
        a, b = open_[near], other[near]
        met[near] = _same(data, starts[a], starts[b], lengths[a])
        open_ = open_[~met]
        slots[open_] = (slots[open_] + 1) & (size - 1)
    bucket = np.zeros(size, np.int64)
    used = np.flatnonzero(owner >= 0)
    first = owner[used]
    whole = data.tobytes()
    bucket[used] = [
        bucket_of(whole[a:b])
        for a, b in zip(starts[first].tolist(), (starts[first] + lengths[first]).tolist(), strict=True)
    ]
    return Table(owner, np.bincount(slots, minlength=size), bucket, slots)
