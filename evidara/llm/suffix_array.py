"""A suffix array by Lyndon grouping, for integer sequences: linear once the symbols are ranked."""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[list[int]], list[int]]:
    """Positions grouped by the longest Lyndon prefix of their suffixes, greatest group first, and for each position the last
    earlier one whose group is smaller (-1: none). The last symbol must be the only smallest one.

    Groups start as the equal first symbols and are taken in descending order. When one is taken its members' groups are final;
    each member extends the prefix of the position before it that has a smaller group, so those parents move, within their own groups,
    above the rest, the further the more members they got. A position leaves a group by its label; its stale entry is skipped later.

    Members stay in ascending order without sorting: the parents of ascending members ascend too, since a parent between a member and its own parent
    would have been nearer. Parents are taken by their number of members from buckets, so every step is linear in the members of its group."""
    n = len(text)
    rank = {c: i for i, c in enumerate(sorted(set(text)))}
    label = [rank[c] for c in text]
    members: list[list[int]] = [[] for _ in rank]
    for i, g in enumerate(label):
        members[g].append(i)
    below = list(range(-1, len(rank) - 1))
    above = [*range(1, len(rank)), -1]
    before, done, out = [-1] * n, bytearray(n), []
    g = len(rank) - 1
    while g >= 0:
        own = [s for s in members[g] if label[s] == g]
        members[g] = []
        if own:
            extended: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = before[p]
                if p >= 0 and label[p] == g:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    extended[p] = extended.get(p, 0) + 1
            for s in own:
                done[s] = 1
            out.append(own)
            by_count: list[list[int]] = [[] for _ in range(max(extended.values(), default=0) + 1)]
            for p, k in extended.items():
                by_count[k].append(p)
            # the most extended first: each new group goes right above the old one, below those put there before
            for same in reversed(by_count):
                moved: dict[int, list[int]] = {}
                for p in same:
                    moved.setdefault(label[p], []).append(p)
                for old, parents in moved.items():
                    new = len(members)
                    members.append(parents)
                    for p in parents:
                        label[p] = new
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
        g = below[g]
    return out, before


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order. The last symbol must be the only smallest one.

    Within a group the order is that of what follows the common prefix. Taking the suffixes in their final order, each one settles
    the places of those whose prefix ends where it starts: the chain of smaller-group positions from the one before it."""
    groups, before = lyndon_groups(text)
    n = len(text)
    group, free, at = [0] * n, [], 0
    for g, own in enumerate(reversed(groups)):
        free.append(at)
        at += len(own)
        for s in own:
            group[s] = g
    order = [0] * n
    order[0] = n - 1
    for i in range(n):
        start = order[i]
        s, stop = start - 1, before[start]
        while s != stop:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            s = before[s]
    return order
