"""Suffix array by linear grouping.

Suffixes are first grouped by their symbol. Groups are processed from the highest down: each
member's previous-smaller pointer goes to the nearest earlier suffix that is in a lower group
now, and the suffixes pointed at leave their group for a new one just above it, those pointed
at more often higher. In the end suffixes are grouped by their Lyndon prefix, in order. The
array is then emitted from the lowest suffix up: what precedes an emitted suffix, and all that
its pointers lead to, are next in their groups. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``, whose last symbol is smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # a group is known by the first place that its suffixes take in the array
    count: dict[int, int] = {}
    for symbol in text:
        count[symbol] = count.get(symbol, 0) + 1
    place, size, group_at_end, start = {}, {}, {}, 0
    for symbol in sorted(count):
        place[symbol], size[start] = start, count[symbol]
        start += count[symbol]
        group_at_end[start] = place[symbol]
    group = [place[s] for s in text]
    members: dict[int, list[int]] = {g: [] for g in size}
    for i, g in enumerate(group):
        members[g].append(i)
    prev = [-1] * n
    end = n
    while end > 0:
        g = group_at_end[end]
        end = g
        # entries of suffixes that have left the group are skipped
        own = [i for i in members[g] if group[i] == g]
        if len(own) > 1:
            own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        if len(pointed) == 1:
            moves = [list(pointed)]
        else:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                parts.setdefault((times, group[j]), []).append(j)
            moves = [parts[key] for key in sorted(parts, reverse=True)] if len(parts) > 1 else list(parts.values())
        for moved in moves:
            old = group[moved[0]]
            rest = size[old] - len(moved)
            if not rest:
                continue  # the whole group moves: it keeps its place
            new = old + rest
            group_at_end[new + len(moved)] = new
            group_at_end[new] = old
            size[old], size[new] = rest, len(moved)
            members[new] = moved
            for j in moved:
                group[j] = new
    front = {g: g for g in size}
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for rank in range(n):
        j = order[rank] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = prev[j]
    return order
