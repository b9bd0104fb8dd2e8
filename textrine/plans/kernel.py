"""Suffix trees of a batch of texts, by numpy over whole arrays.

All texts of a batch are laid end to end, each with a terminator that is
greater than any character. Suffixes are sorted within their text by prefix
doubling; the ranks of every doubling step are kept, from which the longest
common prefixes of neighbours follow without a per-character loop. Every
branching node is an interval of equal-or-greater common prefixes, which ends
where the next smaller one is on either side.

Nothing here is per character Python: each step is a sort, a gather or a
cumulative operation on the batch's arrays.
"""

from __future__ import annotations

import numpy as np

END = 0x110000
#: Characters that are indexed at once (and one text, if it is longer).
PART = 120_000
#: Steps that entries walk together to the next smaller one.
WALK = 500


def slices(sizes, most: int = PART):
    """(from, to) ranges of rows whose sizes sum to about ``most`` at most."""
    lo = held = 0
    for i, s in enumerate(sizes):
        if i > lo and held + s > most:
            yield lo, i
            lo, held = i, 0
        held += s
    if lo < len(sizes):
        yield lo, len(sizes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters with a terminator after each text, and the texts' bounds."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
    out = np.full(bounds[-1], END, np.int64)
    for p, b in zip(parts, bounds):
        out[b : b + len(p)] = p
    return out, bounds


def changes(values: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before them."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return fresh


def packed_codes(chars: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Integers that order suffixes by their text and first 1, 2, 4 and 8 characters.

    As many as fit in 62 bits with the batch's alphabet; what lies behind a
    text's end counts as 0.
    """
    chars = np.minimum(chars, np.where(chars == END, 0, chars).max(initial=0) + 1)  # a short table of what is present
    present = np.zeros(int(chars.max(initial=0)) + 1, bool)
    present[chars] = True
    code = np.cumsum(present)[chars]  # from 1; the terminator has the greatest
    size = int(present.sum()) + 1
    docs = int(doc[-1]) + 1 if len(doc) else 1
    out, tail, width = [], code, 1
    while True:
        out.append(doc * size**width + tail)
        if width == 8 or docs * size ** (2 * width) >= 1 << 62:
            return out
        behind = np.zeros_like(tail)
        behind[:-width] = tail[width:]
        behind[np.arange(len(tail)) + width >= end] = 0
        tail, width = tail * size**width + behind, 2 * width


class SparseMin:
    """Range minima of an array, as (value, position) packed in one integer."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n = n
        self.levels = [(values.astype(np.int64) << 32) | np.arange(n)]
        while (1 << len(self.levels)) <= n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[: n - 2 * half + 1], last[half : n - half + 1]))

    def packed(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over lo..hi (inclusive, lo <= hi)."""
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k) + 1])
        return out

    def argmin(self, lo, hi):
        return self.packed(lo, hi) & 0xFFFFFFFF

    def minimum(self, lo, hi):
        return self.packed(lo, hi) >> 32

    def smaller_before(self, values: np.ndarray) -> np.ndarray:
        """For each i the last j < i with a smaller value, or -1."""
        at = np.arange(self.n)
        for k in range(len(self.levels) - 1, -1, -1):
            can = at >= (1 << k)
            start = np.where(can, at - (1 << k), 0)
            ok = can & ((self.levels[k][np.minimum(start, len(self.levels[k]) - 1)] >> 32) >= values)
            at = np.where(ok, start, at)
        return at - 1


def smaller_before(values: np.ndarray, equal: bool = False) -> np.ndarray:
    """For each entry from 0 up the last one before it that is smaller (or ``equal``); there has to be one.

    Entries walk back together, over greater ones by what those have found. The
    few that are not there after WALK steps look it up in a table of minima.
    """
    back = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(values >= 0)
    for _ in range(WALK):
        todo = todo[values[back[todo]] >= values[todo] + equal]
        if not len(todo):
            return back
        back[todo] = back[back[todo]]
    back[todo] = SparseMin(values).smaller_before(values + equal)[todo]
    return back


def least_within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value of each range lo..hi (inclusive, lo <= hi), ranges of one width after another."""
    out, level = np.empty(len(lo), np.int64), np.frexp((hi - lo + 1).astype(float))[1] - 1
    by, counts = np.argsort(level, kind="stable"), np.bincount(level)
    minima, done = values.astype(np.int32), 0
    for k, many in enumerate(counts.tolist()):
        if k:
            half = 1 << (k - 1)
            minima = np.minimum(minima[:-half], minima[half:])
        at = by[done : done + many]
        out[at] = np.minimum(minima[lo[at]], minima[hi[at] - (1 << k) + 1])
        done += many
    return out


def last_least(values: np.ndarray, before: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The last place in each lo..hi with the range's ``least`` value; ``before`` as of ``smaller_before`` with ``equal``.

    As there, ranges walk back together and the few that take long look it up.
    """
    at, todo = hi.copy(), np.arange(len(hi))
    for _ in range(WALK):
        todo = todo[values[at[todo]] > least[todo]]
        if not len(todo):
            return at
        at[todo] = before[at[todo]]
    at[todo] = SparseMin(values).argmin(lo[todo], hi[todo])
    return at


class SuffixArrays:
    """Sorted suffixes of a batch: ``order`` (positions), ``rank``, ``lcp`` with the one before (-1 at a text's first)."""

    def __init__(self, texts: list[str]):
        self.chars, self.bounds = code_points(texts)
        n = len(self.chars)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.end = self.bounds[1:][self.doc]
        levels = packed_codes(self.chars, self.doc, self.end)
        # a rank is the number of smaller suffixes, so that only those still tied are sorted again
        order, rank = np.argsort(levels[-1]), np.empty(n, np.int64)
        fresh = changes(levels[-1][order])
        parted = np.where(fresh, len(levels) - 1, -1)  # the step that tells a sorted suffix from the one before
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        levels[-1] = rank.astype(np.int32)
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        while len(tied):
            at = order[tied]  # equal so far, hence the text does not end there
            key = rank[at] * (n + 1) + rank[at + (1 << (len(levels) - 1))]
            by = np.argsort(key)
            order[tied] = at = at[by]
            fresh = changes(key[by])
            rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
            new = tied[fresh]
            parted[new[parted[new] < 0]] = len(levels)
            levels.append(rank.astype(np.int32))
            tied = tied[~(fresh & np.append(fresh[1:], True))]
        self.order, self.rank = order, rank
        # codes and ranks of step s tell whether 2^s characters are equal
        second = np.ones(n, bool)
        second[self.bounds[:-1]] = False
        second = np.flatnonzero(second)
        a, b, last = order[second], order[second - 1], parted[second]
        for s in range(len(levels) - 2, -1, -1):
            some = np.flatnonzero(last > s)
            some = some[levels[s][a[some]] == levels[s][b[some]]]
            a[some] += 1 << s
            b[some] += 1 << s
        self.lcp = np.full(n, -1)
        self.lcp[second] = a - order[second]

    @property
    def start(self) -> np.ndarray:
        """1-based start of each sorted suffix in its text."""
        return self.order - self.bounds[self.doc] + 1


class SuffixTrees:
    """Branching nodes and edges of the suffix tree of each text of a batch.

    Node arrays are ordered by (text, node id): ``node_doc``, ``node_id``,
    ``depth``, ``head``, ``first`` (leftmost occurrence), ``parent`` and ``link``
    (row numbers of nodes, -1 for none), ``leaves_below``. ``leaf_parent`` has the row
    number of the node above each position's leaf.
    """

    def __init__(self, texts: list[str]):
        self.sa = sa = SuffixArrays(texts)
        n, docs = len(sa.chars), len(texts)
        lcp = np.concatenate([sa.lcp, [-1]])  # lcp[i]: between sorted i-1 and i
        # a node is known by the first of its values: one whose last value before that is not greater is smaller
        before = smaller_before(lcp, equal=True)
        one = (lcp >= 0) & (lcp[before] < lcp)
        at = np.flatnonzero(one)
        known = np.where(one | (lcp < 0), np.arange(n + 1), before)
        while True:
            further = known[known]
            if (further == known).all():
                break
            known = further
        node_left, depth = before[at], lcp[at]
        node_right = n - smaller_before(lcp[::-1].copy())[n - at] - 1
        node_doc = sa.doc[sa.order[node_left]]
        row_of = np.where(lcp >= 0, (np.cumsum(one) - 1)[known], -1)  # of a position between two sorted suffixes
        # a text without characters has a root with its only leaf
        bare = np.flatnonzero(np.diff(sa.bounds) == 1)
        place = sa.rank[sa.bounds[bare]]
        node_left, node_right = np.concatenate([node_left, place]), np.concatenate([node_right, place])
        depth, node_doc = np.concatenate([depth, np.zeros(len(bare), np.int64)]), np.concatenate([node_doc, bare])
        rows = len(depth)
        bare_row = np.full(docs, -1, np.int64)
        bare_row[bare] = np.arange(rows - len(bare), rows)

        above = lambda lo, hi: row_of[np.where(lcp[lo] >= lcp[hi + 1], lo, hi + 1)]
        parent = np.where(depth == 0, -1, above(node_left, node_right))
        position = np.arange(n)
        leaf_parent = above(position, position)
        leaf_parent = np.where(bare_row[sa.doc[sa.order]] >= 0, bare_row[sa.doc[sa.order]], leaf_parent)

        first = least_within(sa.order, node_left, node_right)
        # head: least start among the children but the one with the first occurrence
        deep = np.flatnonzero(depth > 0)
        head = np.full(rows, n, np.int64)
        for kid_parent, kid_start in ((parent[deep], first[deep]), (leaf_parent, sa.order)):
            other = kid_start != first[kid_parent]
            np.minimum.at(head, kid_parent[other], kid_start[other])
        head = np.where(depth > 0, head - sa.bounds[node_doc] + 1, 0)
        children = np.bincount(parent[parent >= 0], minlength=rows) + np.bincount(leaf_parent, minlength=rows)

        link = np.full(rows, -1, np.int64)
        p, q = sa.rank[sa.order[node_left[deep]] + 1], sa.rank[sa.order[node_right[deep]] + 1]
        link[deep] = row_of[last_least(lcp, before, np.minimum(p, q) + 1, np.maximum(p, q), depth[deep] - 1)]

        # heads of a text differ, and 0 is the root's
        place = np.full(n + 1, -1, np.int64)
        place[sa.bounds[node_doc] + head] = np.arange(rows)
        order = place[place >= 0]
        back = np.empty(rows + 1, np.int64)
        back[order] = np.arange(rows)
        back[-1] = -1
        self.node_doc, self.depth, self.head = node_doc[order], depth[order], head[order]
        self.first = first[order] - sa.bounds[self.node_doc] + 1
        self.left, self.right = node_left[order], node_right[order]
        self.parent, self.link, self.children = back[parent[order]], back[link[order]], children[order]
        counts = np.bincount(self.node_doc, minlength=docs)
        self.node_id = np.arange(rows) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        self.leaf_parent = back[leaf_parent]
        self.nodes_of = counts

    def edges(self) -> dict[str, np.ndarray]:
        """All edges, ordered by text and traversal (ascending path, end greatest).

        A node comes before the suffixes below it, shorter nodes first.
        """
        sa = self.sa
        n = len(sa.chars)
        inner = np.flatnonzero(self.parent >= 0)
        inner = inner[np.argsort(self.left[inner] * (n + 1) + self.depth[inner])]
        left = self.left[inner]
        # before a node's edge are the nodes sorted before it and the suffixes before its first, before a leaf's the nodes up to its place
        at_inner = np.arange(len(inner)) + left
        at_leaf = np.arange(n) + np.cumsum(np.bincount(left, minlength=n))

        def merged(of_nodes, of_leaves):
            out = np.empty(len(inner) + n, np.int64)
            out[at_inner], out[at_leaf] = of_nodes, of_leaves
            return out

        top, sa_start = merged(self.parent[inner], self.leaf_parent), sa.start
        link = self.link[inner]
        out = {
            "doc": self.node_doc[top], "parent": self.node_id[top], "parent_depth": self.depth[top], "child": merged(self.node_id[inner], -sa_start),
            "child_depth": merged(self.depth[inner], sa.end[sa.order] - sa.order), "start": merged(self.head[inner], sa_start),
            "suffix_link": merged(np.where(link >= 0, self.node_id[link], 0), 0), "is_leaf": merged(0, 1) > 0,
        }
        counts = np.bincount(out["doc"], minlength=len(sa.bounds) - 1)
        out["ord"] = np.arange(len(top)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        return out
