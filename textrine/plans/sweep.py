"""Counts of the trees of all windows of a text, from one tree of the text.

A node of the text's tree branches in the windows that hold two occurrences with
different next letters, and then there are two neighbours among its occurrences
that do. So each pair of neighbours gives an interval of window starts, and a
sweep over the ends of all nodes' intervals counts every window's nodes at once.

The leaves of a window are its suffixes but those that occur in it before; of these
the longest counts. A suffix from s on occurs before if a neighbour of s, among the
occurrences of the node above it, lies in the window: again an interval of window
starts for each pair, of which each window takes the least s.
"""

from __future__ import annotations

import numpy as np

from textrine.plans.kernel import SuffixTrees

#: Occurrences that are sorted at once (and one node's, if it has more).
ENTRIES = 200_000
#: Window starts of a text that are swept at once, if windows are not longer.
STARTS = 50_000
NONE = np.iinfo(np.int64).max


class LeastOver:
    """Least value of the intervals over each place, from 2^k-wide minima."""

    def __init__(self, n: int):
        self.n, self.levels = n, np.zeros(0, np.int64)

    def add(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
        if not len(lo):
            return
        level = np.frexp((hi - lo + 1).astype(float))[1].astype(np.int64) - 1
        missing = (int(level.max()) + 1) * self.n - len(self.levels)
        if missing > 0:
            self.levels = np.concatenate([self.levels, np.full(missing, NONE)])
        row = level * self.n
        np.minimum.at(self.levels, row + lo, value)
        np.minimum.at(self.levels, row + hi - (1 << level) + 1, value)

    def values(self) -> np.ndarray:
        tables = self.levels.reshape(-1, self.n)
        table = np.full(self.n, NONE)
        for k in range(len(tables) - 1, 0, -1):
            table = np.minimum(table, tables[k])
            half = 1 << (k - 1)
            table[half:] = np.minimum(table[half:], table[:-half].copy())  # a place covers the 2^k from it on
        return np.minimum(table, tables[0]) if len(tables) else table


class Sweep:
    """Intervals of window starts over the tree of each text; a text under ``size`` characters is one window."""

    def __init__(self, texts: list[str], size: int):
        self.tree = t = SuffixTrees(texts)
        self.first, n = t.sa.bounds[:-1], np.diff(t.sa.bounds) - 1
        self.width = np.minimum(size, n)
        self.last = self.first + n - self.width  # of the windows' starts
        self.total = len(t.sa.chars)
        self.above = np.where(t.parent >= 0, t.depth[t.parent], 0)

    def neighbours(self):
        """(node, a, b): neighbours among the occurrences of each node that a window may need, in order; some nodes at a time.

        A window needs both and one letter more than the node above has.
        """
        t, total = self.tree, self.total
        nodes = np.flatnonzero((t.depth > 0) & (self.above <= self.width[t.node_doc] - 2))
        counts = (t.right - t.left + 1)[nodes]
        cuts = np.searchsorted(np.cumsum(counts), np.arange(ENTRIES, counts.sum() + ENTRIES, ENTRIES), "right")
        for lo, hi in zip(np.concatenate([[0], cuts[:-1]]), cuts):
            some, many = nodes[lo:hi], counts[lo:hi]
            owner = np.repeat(np.arange(len(some)), many)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + t.left[some][owner]
            key = np.sort(owner * (total + 1) + t.sa.order[place])
            owner, at = key // (total + 1), key % (total + 1)
            room = (self.width[t.node_doc] - 1 - self.above)[some]
            pair = np.flatnonzero((owner[1:] == owner[:-1]) & (at[1:] - at[:-1] <= room[owner[1:]]))
            yield some[owner[pair]], at[pair], at[pair + 1]

    def different(self, node, a, b):
        """Pairs with different next letters, as (node, first window start that holds both letters, last one that holds ``a``)."""
        t, doc = self.tree, self.tree.node_doc[node]
        depth, chars = t.depth[node], t.sa.chars
        left = b + depth - self.width[doc] + 1
        real = (left <= self.last[doc]) & (chars[a + depth] != chars[np.minimum(b + depth, self.total - 1)])
        return node[real], left[real], a[real]

    def repeats(self, node, a, b, least: LeastOver, first: np.ndarray | None = None) -> None:
        """Where the suffix from b on occurs before, at a. With ``first``, after a window has lost its first letter, and there the least b of each a that this takes away."""
        doc = self.tree.node_doc[node]
        w, depth = self.width[doc], self.tree.depth[node]
        left = np.maximum(b + self.above[node] + 1 - w, self.first[doc])
        right = np.minimum(b + depth - w, self.last[doc])
        if first is not None:
            real = (left <= a) & (a <= right)
            np.minimum.at(first, a[real], b[real])
            a = a - 1
        upto = np.minimum(right, a)
        real = left <= upto
        least.add(left[real], upto[real], b[real])

    def windows(self, d: int) -> np.ndarray:
        return np.arange(self.first[d], self.last[d] + 1)


def swept(texts: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(branching nodes, leaves) of every window of ``size`` characters of each text."""
    s = Sweep(texts, size)
    change, least = np.zeros(s.total + 1, np.int64), LeastOver(s.total)
    for node, a, b in s.neighbours():
        s.repeats(node, a, b, least)
        node, left, right = s.different(node, a, b)
        doc = s.tree.node_doc[node]
        left, right = np.maximum(left, s.first[doc]), np.minimum(right, s.last[doc])
        real = left <= right
        node, left, right = node[real], left[real], right[real]
        over = np.flatnonzero(node[1:] == node[:-1]) + 1  # both ends grow along a node's pairs
        left[over] = np.maximum(left[over], right[over - 1] + 1)
        new = left <= right
        change += np.bincount(left[new], minlength=s.total + 1) - np.bincount(right[new] + 1, minlength=s.total + 1)
    bn, start = 1 + np.cumsum(change), least.values()
    out = []
    for d in range(len(texts)):
        at = s.windows(d)
        out.append((bn[at], s.width[d] - np.where(start[at] == NONE, 0, at + s.width[d] - start[at])))
    return out


def slides(texts: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each window but the last loses with its first letter: (start of the leaf that the lost one is shortened to or -1, depth of the node that is merged or -1)."""
    s = Sweep(texts, size)
    after, first, merged = LeastOver(s.total), np.full(s.total, NONE), np.full(s.total, -1)
    for node, a, b in s.neighbours():
        s.repeats(node, a, b, after, first)
        node, left, a = s.different(node, a, b)
        # the window from a on has this pair, and no later pair of the node
        alone = np.append((node[1:] != node[:-1]) | (left[1:] > a[:-1]), True)
        lost = (left <= a) & alone & (a <= s.last[s.tree.node_doc[node]])
        merged[a[lost]] = s.tree.depth[node[lost]]
    new = after.values()
    old = np.minimum(new, first)
    out = []
    for d in range(len(texts)):
        at = s.windows(d)[:-1]
        out.append((np.where((old[at] != NONE) & (old[at] != new[at]), old[at] - s.first[d], -1), merged[at]))
    return out


def of_long_text(count, text: str, size: int, most: int = STARTS):
    """``count`` (``swept`` or ``slides``) over one text of any length, ``most`` window starts at a time (or a window's size)."""
    step, n = max(most, size), len(text)
    more = size if count is slides else size - 1  # a slide's window and the letter after it
    parts = [(a, count([text[a : a + step + more]], size)[0]) for a in range(0, max(1, n - size + 1), step)]
    if count is slides:
        parts = [(a, (np.where(x >= 0, x + a, -1), y)) for a, (x, y) in parts]
    return tuple(np.concatenate(x) for x in zip(*(p for _, p in parts)))
