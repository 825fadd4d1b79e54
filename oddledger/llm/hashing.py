"""64-bit hashes of words and word runs, computed over whole batches of UTF-8 text."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 19
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix(np.uint64(seed) + step * np.arange(1, n + 1, dtype=np.uint64))


_BYTE = stream(11, 256)
_BASE = stream(12, 1)[0] | np.uint64(1)
_PLACE = stream(13, 64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash every word of the texts ``data[at[i]:at[i + 1]]``.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower
    case.  Returns (hashes, index of the first word of each text plus the end).
    Work memory stays in proportion to ``SEGMENT`` or the longest word.
    """
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    begins[inner] = inside[inner]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, at)
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(starts, starts[low] + SEGMENT, "left"))
        high = max(high, low + 1)
        left = starts[low]
        right = starts[high] if high < len(starts) else len(data)
        piece = LOWER[data[left:right]]
        live = inside[left:right]
        head = starts[low:high] - left
        place = np.arange(len(piece)) - np.repeat(head, np.diff(np.append(head, len(piece))))
        power = np.cumprod(np.full(int(place.max()) + 1, _BASE))
        part = _BYTE[piece] * power[place]
        part[~live] = 0
        out[low:high] = mix(np.add.reduceat(part, head))
        low = high
    return out, first


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash each run of ``size`` words of one text; a shorter text is one run, an empty text none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        return mix((hashes * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    total = hashes[: n - size + 1] * _PLACE[0]
    for j in range(1, size):
        total += hashes[j : n - size + 1 + j] * _PLACE[j]
    return mix(total + np.uint64(size))


def lowered_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct word runs of each text."""
    hashes, first = words(data, at)
    return [np.unique(runs(hashes[a:b], size)) for a, b in zip(first[:-1], first[1:], strict=True)]
