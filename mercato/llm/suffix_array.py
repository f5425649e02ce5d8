"""Suffix arrays by linear grouping (Lyndon prefixes), without recursive renaming.

First pass: suffixes are in groups by a common prefix, to begin with by their first symbol. Groups are taken
from the highest down. When a group is taken, its members' prefixes are final Lyndon words. From each member a
previous-smaller pointer leads to the nearest suffix on the left in a group not taken yet; that suffix's prefix grows
by the taken group's word, once for each member that points to it, so it moves to a new group just above its old one,
farther above the more often it grew. Second pass: groups in ascending order; behind every suffix in place, the chain of
previous-smaller pointers names the suffixes that come next in their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order; a proper prefix is smaller. Symbols are any comparable ints."""
    n = len(symbols)
    members: list[list[int]] = []
    group = [0] * n
    first = {c: g for g, c in enumerate(sorted(set(symbols)))}
    members = [[] for _ in first]
    for i, c in enumerate(symbols):
        g = first[c]
        group[i] = g
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1] if members else []
    taken = [False] * len(members)
    prev = [-1] * n

    top = len(members) - 1
    g, highest = top, top
    while g >= 0:
        taken[g] = True
        own = [i for i in members[g] if group[i] == g]
        if len(own) > 1:
            own.sort()
        members[g] = own
        grew: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[group[p]]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                grew[p] = grew.get(p, 0) + 1
        if grew:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in grew.items():
                key = (group[p], k)
                if key in split:
                    split[key].append(p)
                else:
                    split[key] = [p]
            for key in sorted(split, reverse=True) if len(split) > 1 else split:
                # Of one old group the largest count comes first, so each smaller count lands just below it.
                old, moved = key[0], split[key]
                new, up = len(members), above[old]
                members.append(moved)
                taken.append(False)
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                else:
                    highest = new
                for p in moved:
                    group[p] = new
        g = below[g]

    chain, g = [], highest
    while g >= 0:
        chain.append(g)
        g = below[g]
    slot = [0] * len(members)
    at = 0
    for g in reversed(chain):
        slot[g] = at
        at += len(members[g])
    order, placed = [-1] * n, [False] * n
    s, k = n, 0
    while True:
        p = s - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[slot[g]] = p
            slot[g] += 1
            placed[p] = True
            p = prev[p]
        if k == n:
            return order
        s = order[k]
        k += 1
