"""Suffix sorting by linear grouping.

Phase one keeps suffixes in groups of equal Lyndon prefix found so far and goes through
the groups in descending order.  Each suffix of a group points to the last position
before it whose group is smaller; a position that is pointed to k times has the
group's prefix k times behind its own, and moves up within its group by k.  Phase two
reads the array from the front: each suffix put in place lets those that end where it
begins take the next place of their groups, along the same pointers.  Nothing is
renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; a proper prefix comes first."""
    n = len(text) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    symbols = np.zeros(n, dtype=np.int64)
    symbols[:-1] = np.unique(text, return_inverse=True)[1] + 1
    order = np.argsort(symbols, kind="stable")
    ranks = symbols[order]
    starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(starts, sizes)
    last = np.zeros(n, dtype=np.int64)  # by a group's first place: its last place
    last[starts] = starts + sizes - 1
    return np.array(_emit(*_group(n, order.tolist(), place.tolist(), group.tolist(), last.tolist())), dtype=np.int64)[1:]


def _group(n: int, order: list[int], place: list[int], group: list[int], last: list[int]) -> tuple[list[int], list[int]]:
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        begin = group[order[end]]
        members = order[begin : end + 1]
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > begin:
                p = smaller[p]
            smaller[s] = p
        times: dict[int, int] = {}
        for s in members:
            p = smaller[s]
            while p >= 0 and group[p] == begin:  # equals of the same group are passed over
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            if most == 1:
                _raise(list(times), order, place, group, last)
            else:
                by_times: dict[int, list[int]] = {}
                for p, k in times.items():
                    by_times.setdefault(k, []).append(p)
                for k in sorted(by_times, reverse=True):
                    _raise(by_times[k], order, place, group, last)
        end = begin - 1
    return group, smaller


def _raise(positions: list[int], order: list[int], place: list[int], group: list[int], last: list[int]) -> None:
    """Split the positions off the upper ends of their groups into groups of their own."""
    touched: dict[int, int] = {}
    for p in positions:
        g = group[p]
        e = last[g]
        if g not in touched:
            touched[g] = e
        at, other = place[p], order[e]
        order[at], place[other] = other, at
        order[e], place[p] = p, e
        last[g] = e - 1
    for p in positions:
        g = group[p]
        group[p] = last[g] + 1
    for g, top in touched.items():
        last[last[g] + 1] = top


def _emit(group: list[int], smaller: list[int]) -> list[int]:
    n = len(group)
    out = [0] * n
    head = list(range(n))
    open_ = bytearray(b"\x01") * n
    out[0] = n - 1
    open_[n - 1] = 0
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and open_[s]:
            g = group[s]
            out[head[g]] = s
            head[g] += 1
            open_[s] = 0
            s = smaller[s]
    return out
