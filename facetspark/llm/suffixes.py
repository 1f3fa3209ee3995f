"""Suffix array by linear grouping: groups of equal Lyndon prefixes, refined from the highest down, then emitted."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of non-negative integers; a shorter suffix comes before its extensions.

    Suffixes are grouped by first symbol, and groups are known by the place where they start. From the
    highest group down, every member is given its previous-smaller pointer: the nearest suffix to the left
    in a lower group. Suffixes that as many members of the group point to are split off the top of their own
    groups, those with most pointers highest. In the end a group holds the suffixes with one Lyndon prefix.
    Then, in order of the suffix array as it fills, the left neighbour of each suffix and its chain of
    pointers take the next free places of their groups. Nothing is renamed or sorted again.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    symbols = np.append(np.asarray(text, np.int64) + 1, 0)  # a smallest end mark
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    firsts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    ends = np.append(firsts[1:], n + 1)
    where = np.empty(n + 1, np.int64)
    where[order] = np.repeat(firsts, ends - firsts)
    group = where.tolist()  # start of each suffix's group
    size = [0] * (n + 1)
    low_of = [0] * (n + 1)  # start of the group that ends at a place
    members: dict[int, list[int]] = {}
    listed = order.tolist()
    for a, b in zip(firsts.tolist(), ends.tolist()):
        size[a], low_of[b - 1] = b - a, a
        members[a] = listed[a:b]
    previous = [-1] * (n + 1)

    top = n
    while top >= 0:
        start = low_of[top]
        now = members.pop(start)
        if len(now) != size[start]:  # some have been split off
            now = [i for i in now if group[i] == start]
        asked: dict[int, int] = {}
        for i in now:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                asked[j] = asked.get(j, 0) + 1
        if asked:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, c in asked.items():
                by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
            for c in sorted(by_count, reverse=True):
                for old, moved in by_count[c].items():
                    m, s = len(moved), size[old]
                    if m == s:
                        continue
                    new = old + s - m
                    size[old], size[new] = s - m, m
                    low_of[old + s - 1], low_of[new - 1] = new, old
                    members[new] = moved
                    for j in moved:
                        group[j] = new
        top = start - 1

    out = [-1] * (n + 1)
    out[0] = n
    free = list(range(n + 1))
    placed = bytearray(n + 1)
    placed[n] = 1
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return np.array(out[1:], np.int64)
