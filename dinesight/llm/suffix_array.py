"""Suffix array by linear grouping, without recursive renaming.

Phase one groups the suffixes by their Lyndon prefix. Groups are taken in
descending order; every suffix of a group finds the nearest earlier suffix that
lies in a lower group (its previous smaller one) along the pointers found
before, and those predecessors leave their group for a higher one right behind
it, the further behind the more members of the taken group they precede. Phase two
emits each group's order: the predecessors of an emitted suffix, along the same
pointers, are the next of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int] | np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` in lexicographic order; an empty text gives an empty array.

    Symbols are non-negative integers. The end of the text sorts before every symbol.
    """
    symbols = np.asarray(text, np.int64)
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order], prepend=-1))
    members: list[set[int] | list[int]] = [list(part) for part in np.split(order, cuts[1:])]
    members = [set(part.tolist() if isinstance(part, np.ndarray) else map(int, part)) for part in members]
    below = list(range(-1, len(members) - 1))  # the next lower group
    above = [*range(1, len(members)), -1]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(np.diff(symbols[order], prepend=-1) != 0) - 1
    home: list[int] = group.tolist()
    done = bytearray(n)
    prev = [-1] * n
    taken: list[int] = []  # groups in descending order
    g = len(members) - 1
    while g >= 0:
        taken.append(g)
        inside = members[g]
        if len(inside) == 1:
            (i,) = inside
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                old = home[j]
                if len(members[old]) > 1:
                    members[old].discard(j)
                    home[j] = _behind(old, {j}, members, below, above)
        else:
            ordered = sorted(inside)
            for i in ordered:
                done[i] = 1
            counts: dict[int, int] = {}
            for i in ordered:
                j = i - 1
                while j >= 0 and done[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    counts[j] = counts.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, c in counts.items():
                moves.setdefault((-c, home[j]), []).append(j)
            for c, old in sorted(moves):
                movers = moves[c, old]
                if len(movers) < len(members[old]):
                    members[old].difference_update(movers)
                    new = _behind(old, set(movers), members, below, above)
                    for j in movers:
                        home[j] = new
        g = below[g]
    starts = [0] * len(members)
    position = 0
    for g in reversed(taken):
        starts[g] = position
        position += len(members[g])
    return _emit(n, home, prev, starts)


def _behind(old: int, inside: set[int], members: list, below: list[int], above: list[int]) -> int:
    """A new group right above ``old``."""
    new = len(members)
    members.append(inside)
    upper = above[old]
    below.append(old)
    above.append(upper)
    above[old] = new
    if upper >= 0:
        below[upper] = new
    return new


def _emit(n: int, home: list[int], prev: list[int], starts: list[int]) -> np.ndarray:
    out = [-1] * n
    placed = bytearray(n)
    s = n - 1  # what precedes the empty suffix, the smallest of all
    filled = 0
    while True:
        while s >= 0 and not placed[s]:
            g = home[s]
            out[starts[g]] = s
            starts[g] += 1
            placed[s] = 1
            s = prev[s]
        if filled == n:
            break
        s = out[filled] - 1
        filled += 1
    return np.array(out, np.int64)
