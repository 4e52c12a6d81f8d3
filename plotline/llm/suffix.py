"""Enhanced suffix arrays over many short strings at once: suffix order, common prefixes, interval scan."""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys, in key order."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) if len(keys) else 0
    return rank


def suffix_array(units: np.ndarray, ends: np.ndarray, longest: int, first: int = 1, packed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp) of strings laid end to end. ``ends[i]`` is the end of position i's string; order and lcp
    never look past it. lcp[j] belongs to suffixes j - 1 and j (lcp[0] is 0). ``longest`` bounds the strings' length.
    ``packed`` may hold ``first`` units in one number for each position, to start the doubling from there."""
    n = len(units)
    pos = np.arange(n)
    levels = [_dense(units if packed is None else packed)]
    step = first

    def ahead(rank: np.ndarray, by: int) -> np.ndarray:
        to = pos + by
        return np.where(to < ends, rank[np.minimum(to, n - 1)], 0)

    while True:
        rank = levels[-1]
        pair = rank * (n + 1) + ahead(rank, step)
        nxt = _dense(pair)
        if step * 2 >= longest or nxt.max(initial=0) == n:
            break
        levels.append(nxt)
        step *= 2
    sa = np.argsort(nxt, kind="stable")
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return sa, lcp
    a, b = sa[:-1], sa[1:]
    off = np.zeros(n - 1, np.int64)
    steps = [first << k for k in range(len(levels))]
    for rank, size in zip(levels[::-1], steps[::-1]):
        for _ in range(2 if size == steps[-1] else 1):  # strings of up to twice the last step are told apart
            i, j = a + off, b + off
            same = (i < ends[a]) & (j < ends[b])
            same &= rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]
            off += np.where(same, size, 0)
    for _ in range(first - 1):
        i, j = a + off, b + off
        same = (i < ends[a]) & (j < ends[b])
        same &= units[np.minimum(i, n - 1)] == units[np.minimum(j, n - 1)]
        if not same.any():
            break
        off += same
    lcp[1:] = np.minimum(off, np.minimum(ends[a] - a, ends[b] - b))
    return sa, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(intervals, best). An interval (first, last, length) of the suffix array, ends included, has suffixes that share
    ``length >= least`` units, no more, and are preceded by at least two different ``left`` values: a maximal repeat with
    all its occurrences. best[j] is the length of the longest one that suffix j belongs to, else 0.

    Walks the tree of common-prefix intervals with a stack; runs whose suffixes all have one left value hold no maximal
    repeat and are skipped whole. ``left`` is given by text position, unique where a string begins."""
    n = len(sa)
    best = np.zeros(n, np.int64)
    out: list[tuple[int, int, int]] = []
    long_enough = lcp >= least
    if n < 2 or not long_enough.any():
        return out, best
    before = left[sa]
    begin = np.flatnonzero(long_enough & ~np.concatenate([[False], long_enough[:-1]])) - 1
    stop = np.flatnonzero(long_enough & ~np.concatenate([long_enough[1:], [False]]))
    # changes[i]: how often the left value differs from its neighbour's among the first i suffixes
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    diverse = changes[stop] > changes[begin]
    for lo, hi in zip(begin[diverse].tolist(), stop[diverse].tolist()):
        heights, turns = lcp[lo + 1 : hi + 1].tolist(), changes[lo : hi + 1].tolist()
        stack: list[tuple[int, int]] = []  # (first suffix of the open interval, its length)
        waiting: list[int] = []  # suffixes that no interval so far has taken
        for k, h in enumerate([*heights, 0]):
            waiting.append(k)
            start = k
            while stack and stack[-1][1] > h:
                start, length = stack.pop()
                if turns[k] > turns[start]:
                    out.append((lo + start, lo + k, length))
                    while waiting and waiting[-1] >= start:
                        best[lo + waiting.pop()] = length
            if h and (not stack or stack[-1][1] < h):
                stack.append((start, h))
    return out, best
