"""Linear suffix sorting by grouping (the construction published by Baier, 2015), for many texts in step.

Phase 1 sorts suffixes into groups by their Lyndon prefix, the text up to the next smaller suffix. Groups start as first characters and are processed in
descending order. For the suffixes of a group, previous-smaller pointers (the nearest earlier suffix in a lower group) tell which
suffixes' prefixes grow by this group's prefix, and how often; those move into new groups right above what is left of their old one. A processed group never
changes again.

Phase 2 emits the order inside each group, ascending: a suffix is its Lyndon prefix u and then the next smaller suffix. That one lies in a lower
group, whose order is known by then, or is a member that starts with u again; so members sort by how often u repeats, then by the rank of the
suffix behind the repeats. No ranks are renamed and nothing recurses.

Both phases run on all texts of a call at once: each step handles one group of every text, as NumPy arrays over the members.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts - starts, counts)


def suffix_arrays(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts codes[offsets[t]:offsets[t + 1]], in the same places of the result, as positions in ``codes``.

    Codes are not negative. Each text must start with a place that is not part of it (its code is ignored; its slot in the result holds its own
    position) and end with a code that is smaller than all others in it."""
    n, starts = len(codes), offsets[:-1]
    text = np.repeat(np.arange(len(starts)), np.diff(offsets))
    key = text * (int(codes.max()) + 2) + codes + 1
    key[starts] = np.arange(len(starts)) * (int(codes.max()) + 2)
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.zeros(n, np.int64)
    size[new] = np.diff(np.append(new, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(new, size[new])
    group[starts] = -1
    prefix = np.ones(n, np.int64)
    previous = np.arange(-1, n - 1)
    touched = np.zeros(n, bool)

    # phase 1: one group of each text at a time, from the top
    top = offsets[1:].copy()
    live = np.flatnonzero(top > starts + 1)
    while len(live):
        ends = top[live]
        lows = group[order[ends - 1]]
        counts = ends - lows
        members = order[ranges(lows, counts)]
        low = np.repeat(lows, counts)
        p = previous[members]
        jump = np.flatnonzero(group[p] >= low)
        while len(jump):
            p[jump] = previous[p[jump]]
            previous[members[jump]] = p[jump]  # members of the same group jump on from here
            jump = jump[group[p[jump]] >= low[jump]]
        grown = group[p] >= 0
        if grown.any():
            hit, at, times = np.unique(p[grown], return_index=True, return_counts=True)
            prefix[hit] += times * prefix[members[grown][at]]
            old = group[hit]
            by = np.lexsort((times, old))
            hit, old, times = hit[by], old[by], times[by]
            first = np.flatnonzero(np.diff(old, prepend=-1))
            moved = np.diff(np.append(first, len(old)))
            olds = old[first]
            tail = olds + size[olds] - moved  # moved suffixes take the last slots of their group
            slots = ranges(tail, moved)
            touched[hit] = True
            there = order[slots]
            pushed = there[~touched[there]]
            touched[hit] = False
            if len(pushed):
                holes = place[hit]
                holes = holes[holes < np.repeat(tail, moved)]
                order[holes] = pushed
                place[pushed] = holes
            order[slots] = hit
            place[hit] = slots
            run = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
            length = np.diff(np.append(run, len(old)))
            size[olds] -= moved
            size[slots[run]] = length
            group[hit] = np.repeat(slots[run], length)
        top[live] = lows
        live = live[lows > starts[live] + 1]

    # phase 2: order inside groups, from the bottom; groups of one are in place
    many = np.flatnonzero((size > 1) & (group[order] == np.arange(n)))
    if len(many):
        owner = text[order[many]]
        nth = np.arange(len(many)) - np.searchsorted(owner, owner)
        by = np.argsort(nth, kind="stable")
        behind, repeats = np.arange(n) + prefix, np.zeros(n, np.int64)
        cuts = np.append(np.flatnonzero(np.diff(nth[by], prepend=-1)), len(many))
        for a, b in zip(cuts[:-1], cuts[1:]):
            lows = many[by[a:b]]
            counts = size[lows]
            slots = ranges(lows, counts)
            members = order[slots]
            low = np.repeat(lows, counts)
            again = np.flatnonzero(group[behind[members]] == low)
            while len(again):
                m = members[again]
                step = behind[m]
                repeats[m] += repeats[step] + 1
                behind[m] = behind[step]
                again = again[group[behind[m]] == low[again]]
            members = members[np.lexsort((place[behind[members]], repeats[members], low))]
            order[slots] = members
            place[members] = slots
    return order
