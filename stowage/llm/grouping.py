"""Suffix arrays by linear grouping construction.

First phase: suffixes are in groups by their first symbol; groups are taken in descending order, every
suffix of a group points to the previous suffix of a smaller group, and the suffixes pointed to move,
by how many pointers they got, to new groups right after their old ones. In the end suffixes
share a group when they share their Lyndon prefix. Second phase: suffixes are written out
group by group, each one followed up its pointers; no ranks are renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of `symbols` in order; a shorter suffix precedes those that extend it."""
    n = len(symbols) + 1  # an end mark below all symbols
    if n == 1:
        return []
    text = np.zeros(n, np.int64)
    text[:-1] = np.unique(np.asarray(symbols), return_inverse=True)[1] + 1
    by_symbol = np.argsort(text, kind="stable")
    starts = np.zeros(int(text.max()) + 2, np.int64)
    np.cumsum(np.bincount(text), out=starts[1:])
    order: list[int] = by_symbol.tolist()  # suffixes by group
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    at: list[int] = place.tolist()  # where a suffix stands in `order`
    group: list[int] = starts[text].tolist()  # a group is named by its first place
    group.append(-1)  # group[-1]: nothing before the first suffix
    past = [0] * n  # end of a group
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b > a:
            past[a] = b
    back = [-1] * n

    end = n
    while end > 0:
        first = group[order[end - 1]]
        if end - first == 1:  # most groups hold one suffix
            i = order[first]
            j = i - 1
            while group[j] >= first:
                j = back[j]
            back[i] = j
            end = first
            if j >= 0:
                old = group[j]
                last = past[old] - 1
                if last > old:
                    p = at[j]
                    if p != last:
                        k = order[last]
                        order[p], at[k] = k, p
                        order[last], at[j] = j, last
                    past[old], past[last] = last, last + 1
                    group[j] = last
            continue
        counts: dict[int, int] = {}
        for i in sorted(order[first:end]):
            j = i - 1
            while group[j] >= first:
                j = back[j]
            back[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        end = first
        if not counts:
            continue
        by_old: dict[int, list[tuple[int, int]]] = {}
        for j, c in counts.items():
            by_old.setdefault(group[j], []).append((c, j))
        for old, moved in by_old.items():
            if len(moved) > 1:
                moved.sort(reverse=True)
            last, size = past[old], len(moved)
            k = 0
            while k < size:  # from the highest count down, each to the tail of what is left
                c = moved[k][0]
                tail = last
                while k < size and moved[k][0] == c:
                    j = moved[k][1]
                    last -= 1
                    p = at[j]
                    if p != last:
                        other = order[last]
                        order[p], at[other] = other, p
                        order[last], at[j] = j, last
                    k += 1
                if last > old:
                    past[last] = tail
                    for q in range(last, tail):
                        group[order[q]] = last
                else:
                    past[old] = tail  # the whole group moves up together: nothing is left of it
            if last > old:
                past[old] = last

    out = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = back[s]
    return out[1:]
