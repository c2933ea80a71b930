"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix, the longest prefix that is smaller than all its own
suffixes. Groups are finished from the greatest to the least. For the members of a
finished group the previous smaller suffix is found by pointers over what is finished already,
and these smaller suffixes leave their groups for new ones just above, as their Lyndon
prefixes grow by the group's. When all are finished, suffixes of a group differ only behind
their common prefix, where a smaller suffix starts. So going through the order from its least suffix,
each emitted suffix puts those before it that end there next in their groups. Nothing is
renamed and nothing is solved recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> tuple[list[int], list[int]]:
    """Suffix array and ranks of a sequence of numbers; its end is smaller than any number."""
    n = len(text)
    if not n:
        return [], []
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    firsts = np.flatnonzero(new)
    start_of = firsts[np.cumsum(new) - 1]
    links = np.empty(n, dtype=np.int64)
    links[order] = start_of
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    sizes = np.zeros(n + 1, dtype=np.int64)
    sizes[firsts] = np.diff(np.append(firsts, n))
    # Lists are faster than arrays for single values.
    sa, group, at, size = order.tolist(), links.tolist(), place.tolist(), sizes.tolist()
    smaller = [-1] * n  # previous smaller suffix, once its group is finished

    end = n
    while end:
        start = group[sa[end - 1]]
        members = sa[start:end] if end - start == 1 else sorted(sa[start:end])
        end = start
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            # What is in this group or above has its own pointer already.
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved = {p: k for p, k in times.items() if size[group[p]] > 1}
        if not moved:
            continue
        most = max(moved.values())
        for k in range(most, 0, -1):
            part = [p for p, t in moved.items() if t == k] if most > 1 else list(moved)
            for p in part:
                g = group[p]
                last = g + size[g] - 1
                here, other = at[p], sa[last]
                sa[here], sa[last] = other, p
                at[other], at[p] = here, last
                size[g] -= 1
            starts = [group[p] + size[group[p]] for p in part]
            for p, s in zip(part, starts):
                group[p] = s
                size[s] += 1

    rank = [-1] * n
    front = list(range(n))  # next free place of the group that starts there
    emitted = n  # the end of the text, the least suffix
    for r in range(n + 1):
        i = emitted - 1
        while i >= 0 and rank[i] < 0:
            g = group[i]
            rank[i] = front[g]
            sa[front[g]] = i
            front[g] += 1
            i = smaller[i]
        if r < n:
            emitted = sa[r]
    return sa, rank


def common_prefixes(text: list[int], sa: list[int], rank: list[int]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order."""
    n = len(text)
    lcp = [0] * n
    length = 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + length < n and j + length < n and text[i + length] == text[j + length]:
                length += 1
            lcp[r] = length
            if length:
                length -= 1
        else:
            length = 0
    return np.array(lcp, dtype=np.int64)
