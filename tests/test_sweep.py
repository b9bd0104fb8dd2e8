"""Counts and losses of all windows of a text against trees of each window."""

import random

import numpy as np
import pytest

from tests.naive import implicit
from textrine.operators import windows
from textrine.plans import sweep


def texts():
    r = random.Random(1)
    return [("".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 30))), r.randint(1, 14)) for _ in range(60)]


def lost(x):
    """(start of the leaf that takes the first one's place or -1, depth of the node that goes or -1) when x loses its first letter."""
    nodes, leaves = implicit(x)
    fewer, still = implicit(x[1:])
    gone = nodes - {""} - fewer
    new = {i + 1 for i in still} - set(leaves)
    assert len(gone) <= 1 and len(new) <= 1
    return (new.pop() - 1 if new else -1), (len(gone.pop()) if gone else -1)


@pytest.mark.parametrize("entries", [5, 60, sweep.ENTRIES])
def test_every_window(monkeypatch, entries):
    monkeypatch.setattr(sweep, "ENTRIES", entries)
    for t, w in texts():
        want = [implicit(t[b : b + w]) for b in range(max(1, len(t) - w + 1))]
        for bn, leaves in (sweep.swept(["xx", t, "abab"], w)[1], sweep.of_long_text(sweep.swept, t, w, 5)):
            assert bn.tolist() == [len(x[0]) for x in want] and leaves.tolist() == [len(x[1]) for x in want]
        want = [lost(t[b : b + w]) for b in range(len(t) - w)]
        want = [(b + x if x >= 0 else -1, y) for b, (x, y) in enumerate(want)]
        for leaf, depth in (sweep.slides(["xx", t, "abab"], w)[1], sweep.of_long_text(sweep.slides, t, w, 5)):
            assert list(zip(leaf.tolist(), depth.tolist())) == want, (t, w)


def test_wide_windows_over_documents(spark):
    """Windows of 100 characters of whole documents, some of them against trees of their own."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) > 150 AND doc_id < 40")
    stats = {r.doc_id: r for r in windows.window_stats(df, 100).collect()}
    losses = {(r.doc_id, r.slide): (r.shortened_to, r.merged_depth) for r in windows.window_slides(df, 100).collect()}
    for doc_id, text in df.collect():
        row = stats[doc_id]
        assert row.observations == len(text) - 99
        for at, bn in ((row.min_bn_at, row.min_bn), (row.max_bn_at, row.max_bn)):
            assert len(implicit(text[at - 1 : at + 99])[0]) == bn
        for at, edges in ((row.min_edges_at, row.min_edges), (row.max_edges_at, row.max_edges)):
            nodes, leaves = implicit(text[at - 1 : at + 99])
            assert len(nodes) - 1 + len(leaves) == edges
        b = len(text) // 3 % (len(text) - 100)
        leaf, depth = lost(text[b : b + 100])
        assert losses[doc_id, b + 1] == (b + leaf + 1 if leaf >= 0 else None, depth if depth >= 0 else None)


def test_long_and_periodic_texts(spark):
    df = spark.createDataFrame([(1, "a" * 120_000), (2, "ab" * 40_000 + "c"), (3, ""), (4, None), (None, "abc"), (5, "abc")], "doc_id long, text string")
    got = {r.doc_id: r for r in windows.window_stats(df, 300).collect()}
    assert set(got) == {1, 2, None, 5}
    assert (got[1].observations, got[1].min_bn, got[1].max_bn, got[1].max_edges) == (119_701, 1, 1, 1)
    assert (got[2].min_bn, got[2].min_edges) == (1, 2) and got[2].max_bn_at == 80_001 - 299
    slides = windows.window_slides(df, 300).where("doc_id = 1").selectExpr("count(*)", "count(shortened_to)", "min(shortened_to - slide)", "count(merged_depth)").first()
    assert tuple(slides) == (119_700, 119_700, 1, 0)  # the only leaf is shortened each time
    assert np.isclose(got[1].avg_edges, 1)


def test_only_neighbours_that_a_window_holds():
    """Occurrences that no window has together are not carried on: work follows the window, not the text's repeats."""
    texts = ["".join(random.Random(3).choices("abcdefgh", k=3000))]
    for size in (3, 8):
        s = sweep.Sweep(texts, size)
        for node, a, b in s.neighbours():
            assert (b - a + s.above[node] < size).all()
