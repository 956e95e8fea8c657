"""Suffix sorting of one shard by induction: sort the leftmost S suffixes, then induce the L and the S suffixes.

All suffixes of one first byte are handled together: a bucket takes its tuples from those before it, in
order, passes on the ones before its own, and repeats for runs of its byte. Numpy does each step over whole
buckets.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (type S); the last, the sentinel, is S."""
    ends = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))
    rises = np.concatenate((t[ends[:-1]] < t[ends[:-1] + 1], [True]))
    return np.repeat(rises, np.diff(np.concatenate(([-1], ends))))


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _named(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost S places (both included), equal for equal ones."""
    m = len(lms)
    sizes = np.append(np.diff(lms), 0) + 1
    symbols = np.append(2 * t.astype(np.uint64) + s, np.zeros(6, np.uint64)) + np.uint64(1)
    rank, offset, active = np.zeros(m, np.int64), 0, np.arange(m)
    while len(active):
        key = np.zeros(len(active), np.uint64)
        for i in range(6):
            inside = offset + i < sizes[active]
            key = key << np.uint64(10) | np.where(inside, symbols[np.where(inside, lms[active] + offset + i, 0)], 0).astype(np.uint64)
        # order within the rank so far; ranks leave room for those that split off
        order = np.lexsort((key, rank[active]))
        a, k = rank[active][order], key[order]
        first = np.concatenate(([True], a[1:] != a[:-1]))
        change = first | np.concatenate(([True], k[1:] != k[:-1]))
        place = np.arange(len(a))
        since = place - np.maximum.accumulate(np.where(first, place, 0))
        rank[active[order]] = a + np.maximum.accumulate(np.where(change, place, 0)) - (place - since)
        offset += 6
        longer = active[sizes[active] > offset]
        group = np.bincount(rank[longer], minlength=m)
        active = longer[group[rank[longer]] > 1]
    return _ranks(rank)


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of the string of names: recursion on names of two, four, ... names at a time."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        if rank.max(initial=0) == n - 1:
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = _ranks(rank * (n + 1) + after)
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, whose last value is smaller than all others; values below 500."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    order = lms[_sorted_names(_named(t, s, lms))]
    by_first = np.argsort(t[order], kind="stable")
    order = order[by_first]
    values = np.arange(int(t.max()) + 2)
    cut = np.searchsorted(t[order], values)

    def induce(buckets: range, seeds: dict[int, np.ndarray], small: bool) -> dict[int, np.ndarray]:
        """For each value, in the order of the scan, the suffixes of one type."""
        waiting: dict[int, list[np.ndarray]] = {}
        done: dict[int, np.ndarray] = {}

        def before(places: np.ndarray) -> np.ndarray:
            places = places[places > 0] - 1
            return places[s[places] == small]

        def pass_on(places: np.ndarray) -> None:
            if not len(places):
                return
            first = t[places]
            by = np.argsort(first, kind="stable")
            places, first = places[by], first[by]
            heads = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(heads, [*heads[1:], len(first)], strict=True):
                waiting.setdefault(int(first[a]), []).append(places[a:b])

        for c in buckets:
            got = []
            now = np.concatenate(waiting.pop(c)) if c in waiting else None
            while now is not None and len(now):
                got.append(now)
                new = before(now)
                own = t[new] == c
                pass_on(new[~own])
                now = new[own]
            if got:
                done[c] = np.concatenate(got)
            if c in seeds:
                pass_on(before(seeds[c]))
        return done

    top = int(t.max())
    large = induce(range(top + 1), {c: order[cut[c] : cut[c + 1]] for c in range(top + 1) if cut[c] < cut[c + 1]}, False)
    small = induce(range(top, -1, -1), {c: x[::-1] for c, x in large.items()}, True)
    parts = [np.array([n - 1])]
    for c in range(top + 1):
        parts += [x for x in (large.get(c), small[c][::-1] if c in small else None) if x is not None]
    return np.concatenate(parts)


def shared_with_previous(t: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether its first ``length`` bytes are those of the one before."""
    padded = np.frombuffer(t + bytes(length + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[: len(padded) - 7].view(), (len(padded) - 7, 8), (1, 1))
    same = np.arange(1, len(order))
    for i in range(0, length, 8):
        i = min(i, length - 8)
        a = np.ascontiguousarray(words[order[same] + i]).view(np.uint64)[:, 0]
        b = np.ascontiguousarray(words[order[same - 1] + i]).view(np.uint64)[:, 0]
        same = same[a == b]
    out = np.zeros(len(order), bool)
    out[same] = True
    return out
