"""Suffix arrays by Lyndon grouping, for many strings side by side.

A group holds the suffixes that share a Lyndon prefix as far as it is known. Groups are processed in descending order,
in each string its greatest unprocessed one: every member finds the nearest earlier suffix in a smaller group (its
previous-smaller pointer, skipping over processed suffixes by theirs), whose known prefix ends just there and now takes
the group's word along, once for each consecutive member. The extended suffixes leave their group for new ones right
above it. When all groups are processed, a suffix's order in its group is that of the suffix behind its Lyndon prefix.
Nothing is renamed or sorted recursively, and the work is linear in the text but for small sorts within a step.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in a row."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - total + size, size)


def suffix_arrays(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of consecutive strings of these sizes, in a row, as positions in text (non-negative numbers)."""
    n = len(text)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Groups by first character: an interval of the final order each, named by its start.
    order = np.lexsort((text, owner))
    change = np.ones(n, bool)
    change[1:] = (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    starts = np.flatnonzero(change)
    group = np.empty(n, np.int64)
    group[order] = starts[np.cumsum(change) - 1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    stop = np.zeros(n + 1, np.int64)
    stop[starts] = np.append(starts[1:], n)
    ending = np.zeros(n + 1, np.int64)  # the group that ends here
    ending[stop[starts]] = starts
    length = np.ones(n, np.int64)
    previous = np.full(n, -1, np.int64)
    chosen = np.zeros(n, bool)
    live = np.flatnonzero(sizes)
    now = ending[(base + sizes)[live]]
    while len(live):
        size = stop[now] - now
        member = order[_ranges(now, size)]
        mine, low = np.repeat(now, size), np.repeat(base[live], size)
        left = member - 1
        while True:  # over suffixes of greater groups
            over = (left >= low) & (group[np.maximum(left, 0)] > mine)
            if not over.any():
                break
            left[over] = previous[left[over]]
        left = np.where(left >= low, left, -1)
        previous[member] = left
        while True:  # over members of the group itself
            over = (left >= 0) & (group[np.maximum(left, 0)] == mine)
            if not over.any():
                break
            left[over] = previous[left[over]]
            previous[member] = left
        found = left >= 0
        if found.any():
            at, first, times = np.unique(left[found], return_index=True, return_counts=True)
            old = group[at]
            by = np.lexsort((times, old))
            word = length[member[found]][first]
            length[at] += times * word
            at, old, times = at[by], old[by], times[by]
            head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            many = np.diff(np.append(head, len(at)))
            g = old[head]
            edge = stop[g]
            slot = _ranges(edge - many, many)  # the upper end of each old interval
            chosen[at] = True
            there = order[slot]
            staying = there[~chosen[there]]
            chosen[at] = False
            vacated = np.sort(place[at])
            vacated = vacated[vacated < np.repeat(edge - many, many)]  # both are in order of the groups
            order[vacated] = staying
            place[staying] = vacated
            order[slot] = at
            place[at] = slot
            run = np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
            begin = slot[run]
            group[at] = begin[np.cumsum(run) - 1]
            last = slot[np.append(np.flatnonzero(run)[1:] - 1, len(slot) - 1)] + 1
            some = edge - many > g
            stop[g[some]] = (edge - many)[some]
            ending[(edge - many)[some]] = g[some]
            stop[begin] = last
            ending[last] = begin
        more = now > base[live]
        now, live = ending[now[more]], live[more]
    return _emit(order, group, place, length, stop, owner, base, sizes)


def _emit(order, group, place, length, stop, owner, base, sizes) -> np.ndarray:  # noqa: ANN001
    """Orders each group by the places of the suffixes behind its Lyndon prefixes, as soon as those are known.

    Those are smaller, so they stand in lower groups or, where a word repeats, in the same one.
    """
    n = len(order)
    if not n:
        return order
    behind = np.arange(n) + length
    ended = behind >= (base + sizes)[owner]
    behind = np.where(ended, 0, behind)
    # A word that repeats: the suffix behind its last repetition, and how often it stands there (more is greater).
    times = np.ones(n, np.int64)
    while len(same := np.flatnonzero(~ended & (group[behind] == group))):
        to = behind[same]
        times[same], ended[same], behind[same] = times[same] + times[to], ended[to], behind[to]
    size = stop[group] - group
    final = size == 1
    todo = np.flatnonzero(~final)
    while len(todo):
        known = ended[todo] | final[behind[todo]]
        waits = np.zeros(n, bool)
        waits[group[todo[~known]]] = True
        ready = todo[~waits[group[todo]]]
        key = np.where(ended[ready], -1, place[behind[ready]])
        ready = ready[np.lexsort((key, times[ready], group[ready]))]
        head = np.concatenate(([True], group[ready][1:] != group[ready][:-1]))
        first = np.flatnonzero(head)
        at = group[ready] + np.arange(len(ready)) - np.repeat(first, np.diff(np.append(first, len(ready))))
        order[at] = ready
        place[ready] = at
        final[ready] = True
        todo = todo[waits[group[todo]]]
    return order
