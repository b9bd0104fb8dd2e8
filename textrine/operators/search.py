"""Patterns in many texts: binary search of all patterns at once on each text's suffix array.

Patterns are taken some PATTERNS at a time to all tasks. A batch of texts is sorted
once; whichever text has a pattern's first HEAD characters is told by hashes of the
texts' own windows, so that texts and patterns are not joined; only these pairs are
searched, all in the same steps. A search goes over as many edges as it takes: the
interval of a pattern's suffixes tells the node above and below the place where it ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.operators.trees import per_batch
from textrine.plans.kernel import SuffixArrays, code_points, least_within

PATTERNS = 50_000
HEAD = 16
#: Bits of the table that tells most places at which no pattern begins.
BITS = np.uint64(20)
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(chars: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` characters from each place on (the last places' are of no use)."""
    n, part, size = len(chars), chars.astype(np.uint64), 1
    out, done = np.zeros(n, np.uint64), 0

    def followed(a, b, by, size):
        both = a * np.uint64(pow(int(BASE), size, 1 << 64))
        both[: max(n - by, 0)] += b[by:]
        return both

    while True:
        if width & size:
            out, done = followed(out, part, done, size), done + size
        if 2 * size > width:
            return out
        part, size = followed(part, part, size, size), 2 * size


class Patterns:
    """Some patterns as places and sizes in one array of characters."""

    def __init__(self, ids: np.ndarray, chars: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.ids, self.chars, self.start, self.size = ids, chars, start, size
        self.known = {}

    def heads(self, width: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
        """Of the patterns of this width: their numbers by hash, the hashes, where each begins and how many it has, and the table of their bits."""
        if w not in self.known:
            some = np.flatnonzero(width == w)
            hashes = window_hashes(self.chars, w)[self.start[some]]
            order = np.argsort(hashes, kind="stable")
            lone, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
            table = np.zeros(1 << int(BITS), bool)
            table[lone * BASE >> np.uint64(64) - BITS] = True
            self.known[w] = some[order], lone, first, count, table
        return self.known[w]

    @classmethod
    def of(cls, ids: np.ndarray, patterns: list[str]) -> "Patterns":
        chars, bounds = code_points(patterns)
        return cls(ids, chars, bounds[:-1], np.diff(bounds) - 1)

    def pairs(self, chars: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern) for each text that has a pattern's first HEAD characters, and few by chance."""
        texts, patterns = [], []
        width = np.minimum(np.where(self.size < 4, self.size, self.size // 4 * 4), HEAD)  # few widths
        for w in np.unique(width[width > 0]).tolist():
            some, lone, first, count, table = self.heads(width, w)
            own = window_hashes(chars, w)
            hit = np.flatnonzero(table[own * BASE >> np.uint64(64) - BITS])
            hit = hit[hit + w < end[hit]]
            at = np.searchsorted(lone, own[hit])
            at[at == len(lone)] = 0
            real = lone[at] == own[hit]
            hit, at = hit[real], at[real]
            met = np.unique(doc[hit] * len(lone) + at)
            text, head = met // len(lone), met % len(lone)
            each = count[head]
            texts.append(np.repeat(text, each))
            patterns.append(some[np.repeat(first[head] - np.cumsum(each) + each, each) + np.arange(each.sum())])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(texts or none), np.concatenate(patterns or none)


def matched(sa: SuffixArrays, at: np.ndarray, p: Patterns, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal leading characters of suffixes and patterns, and the sign of suffix minus pattern (0: it starts with the pattern)."""
    n, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    while True:
        todo = todo[n[todo] < p.size[which[todo]]]
        if not len(todo):
            return n, sign
        # a text's end is greater than any character and no pattern has it
        diff = sa.chars[at[todo] + n[todo]] - p.chars[p.start[which[todo]] + n[todo]]
        sign[todo] = np.sign(diff)
        todo = todo[diff == 0]
        n[todo] += 1


def bound(sa: SuffixArrays, text: np.ndarray, p: Patterns, which: np.ndarray, past: bool) -> np.ndarray:
    """First sorted place in each text whose suffix is not before the pattern; with ``past``, is behind all that start with it."""
    lo, hi = sa.bounds[text].copy(), sa.bounds[text + 1].copy()
    todo = np.arange(len(text))
    while len(todo):
        mid = (lo[todo] + hi[todo]) // 2
        before = matched(sa, sa.order[mid], p, which[todo])[1] < past
        lo[todo[before]] = mid[before] + 1
        hi[todo[~before]] = mid[~before]
        todo = todo[lo[todo] < hi[todo]]
    return lo


def loci(sa: SuffixArrays, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """Of intervals lo..hi-1 of sorted suffixes: count, leftmost start, ranks, depths of the node above and of the node or leaf below."""
    lcp = np.append(sa.lcp, -1)
    below = sa.end[sa.order[lo]] - sa.order[lo]
    many = np.flatnonzero(hi - lo > 1)
    if len(many):
        below[many] = least_within(sa.lcp, lo[many] + 1, hi[many] - 1)
    return {
        "n_occurrences": hi - lo, "leftmost": least_within(sa.order, lo, hi - 1) - sa.bounds[text] + 1 if len(lo) else lo, "rank_lo": lo - sa.bounds[text] + 1,
        "rank_hi": hi - sa.bounds[text], "parent_depth": np.maximum(np.maximum(lcp[lo], lcp[hi]), 0), "child_depth": below,
    }


LOCUS = "n_occurrences long, leftmost int, rank_lo int, rank_hi int, parent_depth int, child_depth int"


def in_blocks(texts: DataFrame, patterns: DataFrame, make, schema: str) -> DataFrame:
    """The union of ``make(Patterns)``'s rows over blocks of at most about PATTERNS patterns."""
    given = patterns.where("pattern_id IS NOT NULL AND pattern != ''").select(F.col("pattern_id").cast("long"), "pattern")
    blocks = -(-given.count() // PATTERNS)
    out = texts.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(blocks)) == b).toPandas()
        out = out.union(per_batch(texts, make(Patterns.of(rows["pattern_id"].to_numpy(np.int64), rows["pattern"].tolist())), schema))
    return out


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, pattern_id of every pattern (pattern_id, pattern) that a text has, with its interval and locus.

    Null and empty patterns are left out; overlapping occurrences count.
    """

    def make(p: Patterns):
        def search(rows):
            chars, bounds = code_points(rows)
            doc = np.repeat(np.arange(len(rows)), np.diff(bounds))
            text, which = p.pairs(chars, doc, bounds[1:][doc])
            if not len(text):
                return {"doc": text, "pattern_id": text, **dict.fromkeys((c.split()[0] for c in LOCUS.split(", ")), text)}
            some, text = np.unique(text, return_inverse=True)
            sa = SuffixArrays([rows[d] for d in some])  # texts without any pattern's first part are not sorted
            lo = bound(sa, text, p, which, False)
            # only those that are there have a second bound to look for
            last = np.minimum(lo, sa.bounds[text + 1] - 1)
            there = (lo < sa.bounds[text + 1]) & (matched(sa, sa.order[last], p, which)[1] == 0)
            text, which, lo = text[there], which[there], lo[there]
            return {"doc": some[text], "pattern_id": p.ids[which], **loci(sa, text, lo, bound(sa, text, p, which, True))}

        return search

    return in_blocks(texts, patterns, make, "doc_id long, pattern_id long, " + LOCUS)


def walks(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The slow scan of each of a few patterns down each text's tree: one row for each text and pattern.

    matched: the letters that are there; slow: 0 if they end on a node, 2 if inside an edge
    and the pattern is over, else the sign of the mismatch (1 if the edge's letter or end is
    greater). The interval and locus are those of the matched part.
    """

    def make(p: Patterns):
        def search(rows):
            sa = SuffixArrays(rows)
            text, which = np.repeat(np.arange(len(rows)), len(p.ids)), np.tile(np.arange(len(p.ids)), len(rows))
            lo = bound(sa, text, p, which, False)
            first, last = sa.bounds[text], sa.bounds[text + 1] - 1
            near = [matched(sa, sa.order[np.clip(x, first, last)], p, which) for x in (lo - 1, lo)]
            n = np.maximum(near[0][0], near[1][0])
            part, own = Patterns(p.ids, p.chars, p.start[which], n), np.arange(len(text))
            lo, hi = bound(sa, text, part, own, False), bound(sa, text, part, own, True)
            out = loci(sa, text, lo, hi)
            on_node, over = n == out["child_depth"], n == p.size[which]
            sign = np.where(near[1][0] == n, near[1][1], near[0][1])
            return {"doc": text, "pattern_id": p.ids[which], "matched": n, "slow": np.where(on_node, 0, np.where(over, 2, sign)), **out}

        return search

    return in_blocks(texts, patterns, make, "doc_id long, pattern_id long, matched int, slow int, " + LOCUS)
