"""Suffix arrays by linear grouping.

Suffixes are first grouped by their Lyndon prefixes (the longest Lyndon word
each starts with), then each group is put in order. Both phases use pointers
to the previous smaller suffix and rename nothing recursively.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of all suffixes of a sequence of integers, in lexicographic order (a prefix comes first).

    Phase 1 takes groups from the highest to the lowest. All suffixes of a
    group start with the same Lyndon word u. For each of them the nearest
    earlier suffix of a lower group is found by following pointers of finished
    groups; such a suffix, with m followers in the group, starts with its own
    word followed by u m times, so it moves to a new group just above its old
    one, the larger m the higher.

    Phase 2 reads the order from the front. Suffixes whose Lyndon word ends
    where the suffix just read starts are next in their groups; they are the
    chain of previous-smaller pointers from the position before it, up to the
    first that has its place already.
    """
    n = len(text)
    if n == 0:
        return []
    # Groups form a linked list in ascending order; `below` and `above` are neighbours.
    group = [0] * n
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    of_symbol: dict[int, int] = {}
    for g, symbol in enumerate(sorted(set(text))):
        of_symbol[symbol] = g
        members.append([])
        below.append(g - 1)
        above.append(g + 1)
    for i, symbol in enumerate(text):
        g = of_symbol[symbol]
        group[i] = g
        members[g].append(i)
    top = len(members) - 1
    above[top] = -1
    done = [False] * (n + 1)  # the last place stands for position -1, which is below everything
    previous = [-1] * n
    size = [len(m) for m in members]

    g = top
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = mine
        if len(mine) > 1:
            mine.sort()
        for i in mine:
            done[i] = True
        followers: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                followers[j] = followers.get(j, 0) + 1
        if followers:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, m in followers.items():
                by_count.setdefault(m, {}).setdefault(group[j], []).append(j)
            for m in sorted(by_count, reverse=True):
                for old, moved in by_count[m].items():
                    if len(moved) == size[old]:
                        continue  # the whole group moves: its place in the order is its own
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new  # up is never -1: g itself is above
                    for j in moved:
                        group[j] = new
        g = below[g]

    # The first free place of each group, in ascending order of groups.
    place = [0] * len(members)
    g = 0
    while below[g] >= 0:
        g = below[g]
    at = 0
    while g >= 0:
        place[g] = at
        at += size[g]
        g = above[g]
    out = [-1] * n
    placed = [False] * n
    # The suffixes that end in a Lyndon word of their own - no smaller suffix follows - come from the virtual empty suffix.
    i = -1
    j = n - 1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = previous[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1
