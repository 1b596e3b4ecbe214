"""Suffix array by grouping: Lyndon-prefix groups in descending order, then emission along previous-smaller pointers."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last one is the smallest and occurs once.

    Groups of suffixes start as equal first symbols. Groups are taken from the largest down. For each suffix s of the
    group taken, prev(s) is the nearest earlier suffix of a smaller group; the prefix of prev(s) is followed by the
    group's prefix, once for each s that points at it in a row. So the suffixes pointed at leave the tops of their groups
    for new groups right above, those pointed at more often higher. In the end a group shares its Lyndon prefix.

    Then suffixes are emitted in order from the smallest: after suffix x come, each at the next free place of its
    group, x - 1 and on along prev until one that is emitted. Linear time in both parts, and no recursion.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    _, first = np.unique(text[order], return_index=True)
    members = [g.tolist() for g in np.split(order, first[1:])]
    count = len(members)
    gid = np.empty(n, np.int64)
    gid[order] = np.repeat(np.arange(count), np.diff(np.r_[first, n]))
    gid = gid.tolist()
    below = list(range(-1, count - 1))
    above_of = list(range(1, count)) + [-1]
    done = [False] * count
    prev = [-1] * n
    g = count - 1
    while g >= 0:
        hits: dict[int, list[tuple[int, int]]] = {}
        last, times = -1, 0
        done[g] = True
        for s in members[g]:
            if gid[s] != g:
                continue
            p = s - 1
            while p >= 0 and done[gid[p]]:
                p = prev[p]
            prev[s] = p
            if p == last:
                times += 1
                continue
            if last >= 0:
                hits.setdefault(gid[last], []).append((last, times))
            last, times = p, 1
        if last >= 0:
            hits.setdefault(gid[last], []).append((last, times))
        for h, found in hits.items():
            by_times: dict[int, list[int]] = {}
            for p, k in found:
                by_times.setdefault(k, []).append(p)
            under = h
            for k in sorted(by_times):
                new, over = len(members), above_of[under]
                members.append(by_times[k])
                done.append(False)
                below.append(under)
                above_of.append(over)
                above_of[under] = new
                if over >= 0:
                    below[over] = new
                for p in by_times[k]:
                    gid[p] = new
                under = new
        g = below[g]
    sizes = np.bincount(gid, minlength=len(members)).tolist()
    free, at, g = [0] * len(members), 0, 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        free[g] = at
        at += sizes[g]
        g = above_of[g]
    out = [-1] * n
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    free[gid[n - 1]] += 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            h = gid[p]
            out[free[h]] = p
            free[h] += 1
            placed[p] = True
            p = prev[p]
    return np.array(out)
