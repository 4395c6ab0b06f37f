"""Suffix arrays in linear steps by grouping suffixes that share a Lyndon prefix.

Phase one takes the groups from the greatest down. Every suffix of a group finds
the nearest suffix to its left in a lower group, its previous smaller one; those
that are pointed to grow their Lyndon prefix and move to a group right above
their old one, in the order of how many pointers they got. Phase two walks the
array from the left: each suffix sends the one before it, and that one's chain
of previous smaller suffixes, to the front of their groups. Nothing is renamed
and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer sequence, in ascending order; a shorter one goes first."""
    symbols = np.asarray(symbols)
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    by_symbol = np.argsort(symbols, kind="stable")
    ranked = symbols[by_symbol]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    last = np.r_[first[1:], n] - 1
    # Positions count from 1; 0 stands for "no smaller suffix", below all groups.
    array = (by_symbol + 1).tolist()
    group, where = np.full(n + 1, -1), np.zeros(n + 1, dtype=np.int64)
    group[by_symbol + 1] = np.repeat(first, last - first + 1)
    where[by_symbol + 1] = np.arange(n)
    end = np.zeros(n, dtype=np.int64)
    end[first] = last
    group, where, end = group.tolist(), where.tolist(), end.tolist()
    previous = _group_all(array, group, where, end)
    return _emit(group, previous)


def _group_all(array: list[int], group: list[int], where: list[int], end: list[int]) -> list[int]:
    """Phase one: ``group`` becomes the final grouping; returns the previous smaller pointers."""
    n = len(array)
    previous = [0] * (n + 1)
    left = list(range(n + 1))  # left[i] = i while i's group is still to come, else a step to the left
    at = n - 1
    while at >= 0:
        i = array[at]
        start = group[i]
        if start == at:  # a group of one, by far the most common
            p = i - 1
            while left[p] != p:
                p = left[p]
            left[i] = previous[i] = p
            if p:
                g = group[p]
                z = end[g]
                if z != g:
                    other, w = array[z], where[p]
                    array[w], where[other], array[z], where[p] = other, w, p, z
                    group[p] = end[z] = z
                    end[g] = z - 1
            at -= 1
            continue
        members = array[start : at + 1]
        for i in members:
            left[i] = i - 1
        found = []
        for i in members:
            p = i - 1
            while left[p] != p:
                q = left[p]
                left[p] = p = left[q]
            left[i] = previous[i] = p
            if p:
                found.append(p)
        once = set(found)
        if len(once) == len(found):
            batches = (found,)
        else:
            pointers: dict[int, int] = {}
            for p in found:
                pointers[p] = pointers.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, k in pointers.items():
                by_count.setdefault(k, []).append(p)
            batches = [by_count[k] for k in sorted(by_count, reverse=True)]
        for batch in batches:
            before: dict[int, int] = {}
            for p in batch:
                g = group[p]
                z = end[g]
                if g not in before:
                    before[g] = z
                w = where[p]
                if w != z:
                    other = array[z]
                    array[w], where[other], array[z], where[p] = other, w, p, z
                end[g] = z - 1
            for g, z in before.items():
                new = end[g] + 1
                if new != g:
                    for p in array[new : z + 1]:
                        group[p] = new
                end[new] = z
        at = start - 1
    return previous


def _emit(group: list[int], previous: list[int]) -> np.ndarray:
    """Phase two: the order inside each group."""
    n = len(group) - 1
    out, free = [0] * n, list(range(n))
    placed = bytearray(n + 1)
    placed[0] = 1
    j = n
    for at in range(n + 1):
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            slot = free[g]
            out[slot] = j
            free[g] = slot + 1
            j = previous[j]
        if at < n:
            j = out[at] - 1
    return np.array(out, dtype=np.int64) - 1
