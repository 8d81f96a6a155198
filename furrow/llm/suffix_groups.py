"""Suffix sorting by grouping: a linear construction without recursive renaming.

First the suffixes are grouped by their longest Lyndon prefix, from the largest group down: each suffix of a
finished group hands its prefix on to the nearest smaller suffix before it, which thereby moves to a larger
group. Then the groups are filled from the smallest on: a suffix that is put out puts every suffix that it
follows as next smaller one into the next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a sequence of non-negative integers in ascending order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    values, first = np.unique(text, return_inverse=True)
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(len(values) + 1)).tolist()
    placed = order.tolist()
    members = [placed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    group = first.tolist()
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    smaller = [0] * n  # previous smaller suffix
    left = list(range(-1, n - 1))  # nearest suffix before that may be unfinished
    done = [False] * n
    finished = []

    g = len(values) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        finished.append(own)
        for i in own:
            done[i] = True
        times: dict[int, int] = {}
        for i in own:
            j = left[i]
            while j >= 0 and done[j]:
                j = left[j]
            k = left[i]
            while k >= 0 and done[k] and k != j:  # shorten the way for later searches
                left[k], k = j, left[k]
            left[i] = smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        raised: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            raised.setdefault((group[j], k), []).append(j)
        # they stand just above their old group, those that got the prefix more often higher
        top, of = -1, -1
        for old, k in sorted(raised):
            if old != of:
                top = of = old
            new = len(members)
            moved = raised[old, k]
            members.append(moved)
            for j in moved:
                group[j] = new
            up = above[top]
            above[top] = new
            below[up] = new  # never the last entry: the group at hand stands above
            below.append(top)
            above.append(up)
            top = new
        g = below[g]

    place, start = [0] * n, 0
    free = [0] * len(members)
    for own in reversed(finished):
        if own:
            free[group[own[0]]] = start
            start += len(own)
    i = -1
    while i < n:
        s = place[i] if i >= 0 else n
        stop = smaller[s] if s < n else -1
        j = s - 1
        while j != stop:
            at = free[group[j]]
            free[group[j]] = at + 1
            place[at] = j
            j = smaller[j]
        i += 1
    return np.array(place, np.int64)
