"""Suffix arrays by grouping suffixes under their Lyndon prefixes.

Phase one starts with a group for each first symbol and works through the groups in
descending order. Every suffix of a group is linked to the nearest suffix before it of a
lower group (its previous smaller one). Suffixes so pointed at move to a new group right
behind their old one, those with more pointers behind those with fewer. In the end
a group holds the suffixes with one and the same longest Lyndon prefix. Phase two runs
once over the array in ascending order: from the suffix before each sorted one, it
follows the same pointers and gives each unsorted suffix met the next free place of its
group. Nothing is renamed or sorted recursively, and both phases take linear time.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (integers >= 0) in ascending order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    head = np.repeat(starts, np.diff(np.append(starts, n)))
    group_of = np.empty(n, np.int64)
    group_of[order] = head
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, group, place = order.tolist(), group_of.tolist(), place.tolist()
    size = [0] * n
    for s, k in zip(starts.tolist(), np.diff(np.append(starts, n)).tolist()):
        size[s] = k
    prev = [-1] * n

    end = n - 1
    while end >= 0:
        start = group[sa[end]]
        if start == end:  # one suffix: one pointer at most
            i = sa[end]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    last = g + k - 1
                    at = place[p]
                    if at != last:
                        other = sa[last]
                        sa[at], place[other] = other, at
                        sa[last], place[p] = p, last
                    size[g] = k - 1
                    group[p] = last
                    size[last] = 1
        else:
            pointers: dict[int, int] = {}
            for i in sorted(sa[start : end + 1]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    pointers[p] = pointers.get(p, 0) + 1
            if pointers:
                by_count: dict[int, list[int]] = {}
                for p, c in pointers.items():
                    by_count.setdefault(c, []).append(p)
                for c in sorted(by_count, reverse=True):
                    moved: dict[int, int] = {}
                    members = by_count[c]
                    for p in members:  # each to the tail of its group
                        g = group[p]
                        m = moved.get(g, 0) + 1
                        moved[g] = m
                        last = g + size[g] - m
                        at = place[p]
                        if at != last:
                            other = sa[last]
                            sa[at], place[other] = other, at
                            sa[last], place[p] = p, last
                    for g, m in moved.items():
                        k = size[g]
                        if m < k:
                            first = g + k - m
                            size[g] = k - m
                            size[first] = m
                            for at in range(first, g + k):
                                group[sa[at]] = first
        end = start - 1

    out = [-1] * n
    free = list(range(n))  # next free place, by group start
    # the empty suffix comes first; the suffix before it is the last one
    j = n - 1
    while j >= 0:
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        group[j] = -1
        j = prev[j]
    for r in range(n):
        j = out[r] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            out[free[g]] = j
            free[g] += 1
            group[j] = -1
            j = prev[j]
    return np.array(out, np.int64)
