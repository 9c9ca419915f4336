"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes.

Both work on one concatenated array of symbols in which texts are set apart by
symbols that occur once, so no common prefix crosses a text's end.
"""

from __future__ import annotations

import numpy as np


def first_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``keys`` and, in that order, where each group of equal keys starts (index of its first member)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return order, np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def shared_only(starts: np.ndarray) -> np.ndarray:
    """Mask of the members of groups of two and more, given each member's group start."""
    n = len(starts)
    sizes = np.diff(np.append(np.flatnonzero(starts == np.arange(n)), n))
    return np.repeat(sizes > 1, sizes)


def refine(suffixes: np.ndarray, starts: np.ndarray, step: int, limit: int | None = None) -> np.ndarray:
    """Sort ``suffixes`` further, in place, until none ties or ``limit`` symbols decide; returns the group starts.

    ``suffixes`` holds every text position in the order of its first ``step``
    symbols; ``starts`` names the start of each one's group.  Every round takes
    only groups with ties and orders them by the group of the suffix ``step``
    symbols further on, which doubles what is decided.
    """
    n = len(suffixes)
    starts = starts.copy()
    rank = np.empty(n, np.int64)
    rank[suffixes] = starts
    open_at = np.flatnonzero(shared_only(starts))
    while len(open_at) and (limit is None or step < limit):
        own, group = suffixes[open_at], starts[open_at]
        further = own + step
        second = np.where(further < n, rank[np.minimum(further, n - 1)], -1)
        order = np.argsort(group * (n + 1) + second + 1, kind="stable")
        own, second = own[order], second[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        suffixes[open_at] = own
        starts[open_at] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        rank[own] = starts[open_at]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(own)))
        open_at = open_at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return starts


def kasai(symbols, suffixes: np.ndarray, heads: np.ndarray, known: int, most: int | None = None, listed=None) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the sorted order, 0 at ``heads``.

    ``heads`` marks suffixes whose predecessor shares fewer than ``known`` symbols.
    Going through the text from left to right, a common prefix of h at i leaves at
    least h - 1 at i + 1, so all comparisons together are linear.  A suffix that
    is not listed breaks the chain; the next one starts from ``known``.  Where the
    list lacks suffixes that share ``known`` symbols, ``listed`` says for every
    position whether it is there.  ``most`` ends the comparison.
    """
    found = np.zeros(len(suffixes), np.int64)
    linked = np.flatnonzero(~heads)
    by_text = linked[np.argsort(suffixes[linked], kind="stable")]
    here = suffixes[by_text].tolist()
    there = suffixes[by_text - 1].tolist()
    most = len(symbols) if most is None else most
    out, last, before, h = [], -2, 0, known
    for i, j in zip(here, there):
        h = max(known, h - 1) if i == last + 1 and (listed is None or listed[before + 1]) else known
        while h < most and symbols[i + h] == symbols[j + h]:
            h += 1
        out.append(h)
        last, before = i, j
    found[by_text] = out
    return found


def deepest(common: np.ndarray) -> np.ndarray:
    """For each suffix, the length of the innermost common-prefix interval that holds it."""
    after = np.zeros_like(common)
    after[:-1] = common[1:]
    return np.maximum(common, after)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask over 0..n-1 of the union of half-open spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:n]) > 0
