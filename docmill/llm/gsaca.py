"""Suffix arrays by grouping: linear construction without recursive renaming.

Suffixes are grouped by their Lyndon prefix, starting from single symbols.
Groups are taken in descending order; the previous-smaller suffix of each
member is prolonged by the group's prefix and moves behind the rest of its own
group. Once all groups are done, one ascending pass emits the order inside
every group: a suffix that is next in order places the suffixes whose Lyndon
prefix ends just before it.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Positions of all suffixes in order. The last symbol must be the only smallest one."""
    n = len(symbols)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        buckets.setdefault(c, []).append(i)
    order, group, size, place = [], [0] * n, [0] * n, [0] * n
    for c in sorted(buckets):
        start = len(order)
        size[start] = len(buckets[c])
        order += buckets[c]
        for i in buckets[c]:
            group[i] = start
    for k, i in enumerate(order):
        place[i] = k

    previous = _group(order, group, size, place)
    return _emit(n, group, previous)


def _group(order: list[int], group: list[int], size: list[int], place: list[int]) -> list[int]:
    """Refine the groups until each is one Lyndon prefix; returns every suffix's previous smaller one (-1: none)."""
    previous = [-1] * len(order)
    end = len(order) - 1
    while end > 0:
        start = group[order[end]]
        if start == end:  # a single suffix, the usual case
            s = order[end]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                if last > g:
                    other, at = order[last], place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                group[p] = last
                size[last] = 1
            end = start - 1
            continue
        members = order[start : end + 1]
        members.sort()  # so that a smaller neighbour in this very group is done first
        hits: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if hits:
            by_count: dict[int, list[int]] = {}
            for p, m in hits.items():
                by_count.setdefault(m, []).append(p)
            for m in sorted(by_count, reverse=True):
                moved = by_count[m]
                for p in moved:
                    g = group[p]
                    size[g] -= 1
                    last = g + size[g]
                    other, at = order[last], place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                starts = [group[p] + size[group[p]] for p in moved]
                for p, new in zip(moved, starts):
                    group[p] = new
                    size[new] = 0
                for new in starts:
                    size[new] += 1
        end = start - 1
    return previous


def _emit(n: int, group: list[int], previous: list[int]) -> list[int]:
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out
