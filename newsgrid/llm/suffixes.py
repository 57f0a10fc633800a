"""Suffix array by linear grouping construction."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in order; a suffix comes before its extensions.

    Symbols are integers of at least 0.  First, suffixes are grouped by their
    longest Lyndon prefix: groups are taken in descending order, each suffix of a
    group finds the nearest position before it in a lower group, and those
    positions move up within their own group by how many suffixes found them.
    Then one ascending scan places every suffix in its group after the suffix
    that follows its Lyndon prefix has been placed.  Nothing is renamed and
    nothing recursed into.
    """
    n = len(text) + 1                             # the empty suffix is the least
    if n == 1:
        return []
    used = {x: i + 1 for i, x in enumerate(sorted(set(text)))}
    symbols = [used[x] for x in text]
    symbols.append(0)
    count = [0] * (len(used) + 2)
    for x in symbols:
        count[x + 1] += 1
    for i in range(len(used) + 1):
        count[i + 1] += count[i]
    fill = count[:]
    order, place, group = [0] * n, [0] * n, [0] * n
    size = [0] * n
    for i, x in enumerate(symbols):
        at = fill[x]
        fill[x] = at + 1
        order[at], place[i], group[i] = i, at, count[x]
        size[count[x]] += 1
    previous = [-2] * n                           # -2: not looked for yet; -1: there is none

    end = n - 1
    while end > 0:
        start = group[order[end]]
        members = order[start:end + 1]
        end = start - 1
        members.sort()
        found: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                q = previous[p]
                p = p - 1 if q == -2 else q
            previous[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if not found:
            continue
        by_times: dict[int, list[int]] = {}
        for p, times in found.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            moved = by_times[times]
            for p in moved:
                g = group[p]
                size[g] -= 1
                at, to = place[p], g + size[g]
                other = order[to]
                order[to], place[p] = p, to
                order[at], place[other] = other, at
            starts = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, starts):
                group[p] = g
                size[g] += 1

    out, free, placed = [0] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = previous[p]
    return out[1:]
