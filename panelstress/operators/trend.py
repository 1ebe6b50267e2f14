"""Kendall's S and the Theil-Sen slope of one series, in memory that grows with its length and not with its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs whose slopes are held at once.
BLOCK = 1 << 20
_BINS = 4096


def inversions(values: np.ndarray) -> int:
    """Pairs in which the earlier value is the larger, counted while merging sorted halves of doubling size."""
    n = len(values)
    if n < 2:
        return 0
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    top = int(ranks.max()) + 1
    rows = np.full(1 << (n - 1).bit_length(), top, dtype=np.int64)  # what fills up is larger than all and stands last
    rows[:n] = ranks
    total, half = 0, 1
    while half < len(rows):
        pairs = rows.reshape(-1, 2 * half)
        shift = np.arange(len(pairs), dtype=np.int64)[:, None]
        left, right = (pairs[:, :half] + shift * (top + 1)).ravel(), (pairs[:, half:] + shift * (top + 1)).ravel()
        not_larger = np.searchsorted(left, right, "right") - np.repeat(shift[:, 0] * half, half)
        total += int((half - not_larger).sum())
        rows = np.sort(pairs, axis=1).ravel()
        half *= 2
    return total


def kendall(values: np.ndarray) -> tuple[int, float]:
    """S, the rising less the falling pairs, and its variance corrected for ties."""
    n = len(values)
    _, ties = np.unique(values, return_counts=True)
    ties = ties.astype(float)
    tied = int((ties * (ties - 1) / 2).sum())
    s = n * (n - 1) // 2 - tied - 2 * inversions(values)
    return s, (n * (n - 1.0) * (2.0 * n + 5.0) - float((ties * (ties - 1.0) * (2.0 * ties + 5.0)).sum())) / 18.0


def _slopes(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Slopes of all pairs, by blocks."""
    n = len(x)
    step = max(1, BLOCK // n)
    for lo in range(0, n - 1, step):
        first = np.arange(lo, min(lo + step, n - 1))[:, None]
        second = np.arange(lo + 1, n)[None]
        keep = second > first
        yield ((y[second] - y[first])[keep]) / ((x[second] - x[first])[keep])


def _kth(x: np.ndarray, y: np.ndarray, ranks: list[int]) -> list[float]:
    """Slopes of the given ranks (neighbours, from 0): the range is narrowed until what lies in it fits a block.

    Every pass counts the slopes of the range in equal bins and goes on with the bins that hold the ranks.
    """
    lo, hi, below = -np.inf, np.inf, 0
    inside = len(x) * (len(x) - 1) // 2
    while inside > BLOCK:
        least = min(s[(s >= lo) & (s <= hi)].min(initial=np.inf) for s in _slopes(x, y))
        most = max(s[(s >= lo) & (s <= hi)].max(initial=-np.inf) for s in _slopes(x, y))
        if least == most:
            return [least] * len(ranks)
        edges = np.unique(np.linspace(least, most, _BINS + 1))
        counts = np.zeros(len(edges) - 1, dtype=np.int64)
        for s in _slopes(x, y):
            counts += np.histogram(s[(s >= least) & (s <= most)], edges)[0]
        upto = below + np.cumsum(counts)
        a, b = (int(np.searchsorted(upto, r, "right")) for r in (ranks[0], ranks[-1]))
        # A bin ends before its upper edge; only the last bin holds it.
        lo, hi = edges[a], edges[b + 1] if b + 2 == len(edges) else np.nextafter(edges[b + 1], -np.inf)
        below, inside = int(upto[a] - counts[a]), int(counts[a : b + 1].sum())
    part = np.concatenate([s[(s >= lo) & (s <= hi)] for s in _slopes(x, y)])
    at = [r - below for r in ranks]
    part.partition(at)
    return [float(part[i]) for i in at]


def theil_sen(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median of the slopes of all pairs; none for fewer than two points. x rises."""
    pairs = len(x) * (len(x) - 1) // 2
    if pairs == 0:
        return None
    middle = [pairs // 2] if pairs % 2 else [pairs // 2 - 1, pairs // 2]
    found = _kth(x.astype(float), y.astype(float), middle)
    return found[0] if pairs % 2 else (found[0] + found[1]) / 2.0
