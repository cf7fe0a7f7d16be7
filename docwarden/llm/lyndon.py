"""Linear suffix sorting by Lyndon-prefix groups.

Phase 1 groups the suffixes by their longest Lyndon prefix.  It starts from one
group per first symbol and takes the groups in descending order.  Each suffix of
the group points at the nearest earlier suffix whose group is still to come (its
previous smaller one); the suffixes pointed at have the group's word after their
own prefix, as many times as pointers meet there, so they move to a new group
right behind their old one, those with more pointers behind those with fewer.

Phase 2 runs once through the order as it grows: the suffix just emitted ends
the Lyndon prefix of the suffix before it and of that one's previous smaller
suffixes, and each of those takes the next place of its group.  No ranks are
renamed and nothing is sorted recursively; the pointer search is path-compressed.
"""

from __future__ import annotations

from collections.abc import Sequence


class _Group:
    """A group in the ascending list of groups that are still to come."""

    __slots__ = ("members", "lower", "higher")

    def __init__(self, members: set[int], lower: _Group | None):
        self.members, self.lower = members, lower
        self.higher = lower.higher if lower else None
        if lower:
            lower.higher = self
        if self.higher:
            self.higher.lower = self


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Previous smaller suffix (-1: none), group number and group sizes, groups counted from the highest."""
    n = len(text)
    by_symbol: dict[int, set[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, set()).add(i)
    top: _Group | None = None
    group_of: list[_Group] = [None] * n  # type: ignore[list-item]
    for symbol in sorted(by_symbol):
        top = _Group(by_symbol[symbol], top)
        for i in top.members:
            group_of[i] = top
    # step[i + 1] leads towards the nearest position <= i whose group is to come; slot 0 stands for none
    step = list(range(n + 1))
    previous, number, sizes = [-1] * n, [0] * n, []
    while top is not None:
        members = sorted(top.members)
        for i in members:
            number[i] = len(sizes)
            step[i + 1] = i
        sizes.append(len(members))
        pointers: dict[int, int] = {}
        for i in members:
            at = i
            while step[at] != at:
                step[at] = at = step[step[at]]
            previous[i] = at - 1
            if at:
                pointers[at - 1] = pointers.get(at - 1, 0) + 1
        shares: dict[tuple[int, int], list[int]] = {}
        for p, times in pointers.items():
            shares.setdefault((-times, id(group_of[p])), []).append(p)
        for key in sorted(shares) if len(shares) > 1 else shares:
            moved = shares[key]
            old = group_of[moved[0]]
            if len(moved) < len(old.members):
                old.members.difference_update(moved)
                new = _Group(set(moved), old)
                for p in moved:
                    group_of[p] = new
        top = top.lower
    return previous, number, sizes


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; a proper prefix comes before what it begins."""
    n = len(text)
    previous, number, sizes = lyndon_groups(text)
    place, above = [], n
    for size in sizes:
        above -= size
        place.append(above)
    order, placed = [0] * n, [False] * n
    for i in range(-1, n):
        j = (order[i] if i >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = number[j]
            order[place[g]] = j
            place[g] += 1
            j = previous[j]
    return order


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix in the order with the one before it."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
