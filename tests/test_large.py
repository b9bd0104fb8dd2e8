"""Trees built across tasks against the kernel; patterns and climbs against enumeration."""

import random

import numpy as np
import pytest

from tests.naive import tree
from textrine.operators import large, navigate, search, trees
from textrine.plans.kernel import code_points

SCHEMA = "doc_id long, text string"


def odd_texts():
    r = random.Random(2)
    texts = ["a" * 90, "banana", "", "abracadabra" * 7, "x", "".join(r.choice("ab") for _ in range(140)), "".join(r.choice("abcdefgh€$\U0001f600\n") for _ in range(150)), "mississippi$mississippi", "ab" * 40 + "c" + "ab" * 40]
    return list(zip([5, 3, 9, 2**53 + 1, -4, 11, 12, 2**53 + 2, 1], texts))


def same(got, want):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("span", [7, 64])
def test_large_equals_kernel(spark, span):
    """Nodes span slices, runs of ties span tasks, and one text is one letter alone."""
    df = spark.createDataFrame([*odd_texts(), (77, None), (None, "no id, no pieces")], SCHEMA)
    known = df.where("doc_id IS NOT NULL")
    index = large.Index(large.pieces(df, 40), span=span, rows=60)
    same(index.suffix_array(), trees.suffix_array(known))
    same(index.nodes(), trees.nodes(known))
    same(index.edges(), trees.edges(known, labels=False))
    index.drop()


def test_large_on_documents(spark):
    """Long repeats between and within texts: some whole documents, in slices far smaller than they are."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 24 AND text IS NOT NULL")
    index = large.Index(large.pieces(df, 1000), span=3000, rows=5000)
    same(index.suffix_array(), trees.suffix_array(df))
    same(index.nodes(), trees.nodes(df))
    index.drop()


def test_large_corners(spark):
    with pytest.raises(ValueError, match="one id"):
        large.Index(large.pieces(spark.createDataFrame([(1, "a"), (1, "b")], SCHEMA)))
    index = large.Index(large.pieces(spark.createDataFrame([], SCHEMA)))
    assert index.nodes().count() == index.edges().count() == index.suffix_array().count() == 0


def test_ids_are_carried_as_they_are(spark):
    df = spark.createDataFrame([(None, "aba"), (2**53 + 1, "aba"), (2**53 + 2, "ab"), (None, "b")], SCHEMA)
    for out, counts in ((trees.suffix_array(df), {None: 6, 2**53 + 1: 4, 2**53 + 2: 3}), (trees.edges(df), {None: 7, 2**53 + 1: 5, 2**53 + 2: 3}), (trees.tree_counts(df), {None: 2, 2**53 + 1: 1, 2**53 + 2: 1})):
        assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == counts


def test_dollar_is_a_letter(spark):
    e = trees.edges(spark.createDataFrame([(1, "a$b"), (2, "$"), (3, "$$")], SCHEMA))
    probes = spark.createDataFrame([(d, 1, "$") for d in (1, 2, 3)] + [(1, 1, "a")], "doc_id long, parent int, letter string")
    got = sorted((r.doc_id, r.letter, r.child) for r in navigate.child_by_letter(e, probes).collect())
    assert got == [(1, "$", -2), (1, "a", -1), (2, "$", -1), (3, "$", 2)]
    s = {(r.doc_id, r.pattern): (r.child, r.matched, r.slow, r.depth) for r in navigate.scans(e, ["$", "$b", "$$", "b$", "$$$"]).collect()}
    assert len(s) == 15
    assert s[1, "$"] == (-2, 1, 2, 1) and s[1, "$b"] == (-2, 2, 2, 1) and s[1, "$$"] == (-2, 1, 1, 1) and s[1, "b$"] == (-3, 1, 1, 0)
    assert s[2, "$"] == (-1, 1, 2, 1) and s[2, "$$"] == (-1, 1, 1, 0) and s[2, "b$"] == (0, 0, None, None)
    assert s[3, "$"] == (2, 1, 0, 0)


def paths(text):
    """String of each node and leaf (leaves with "\\x00" for their end) by id, and its parent."""
    rows = tree(text)[0]
    out, above = {1: ""}, {}
    for parent, _, child, _, label, _ in rows:
        above[child] = parent
    full = {c: text[-c - 1 :] + "\x00" for c in above if c < 0}
    for parent, _, child, depth, label, _ in rows:
        out[child] = full[child] if child < 0 else None
    for leaf, path in full.items():
        at = leaf
        while at != 1:
            up = above[at]
            out[up] = path[: next(d for p, d, c, *_ in rows if c == at and p == up)]
            at = up
    return out, above


def test_climbs_to_own_depths_and_links_of_places(spark):
    texts = ["abcabxabcd", "aaaaaaaaaaaa", "", "abaababaabaab", "a$b$a$"]
    e = trees.edges(spark.createDataFrame(list(enumerate(texts)), SCHEMA), labels=False).cache()
    asks, places = [], []
    for d, t in enumerate(texts):
        path, above = paths(t)
        for node in above:
            asks += [(d, node, x, f"{d}.{node}.{x}") for x in range(len(path[node]))]
            places += [(d, node, x) for x in range(len(path[above[node]]) + 1, len(path[node]))]
    got = {r.tag: (r.parent, r.child, r.exact) for r in navigate.go_up_each(e, spark.createDataFrame(asks, "doc_id long, node int, depth int, tag string")).collect()}
    for d, node, depth, tag in asks:
        path, above = paths(texts[d])
        child = node
        while len(path[above[child]]) > depth:
            child = above[child]
        assert got.pop(tag) == (above[child], child, 0 if len(path[above[child]]) == depth else -1)
    assert not got
    found = navigate.place_links(e, spark.createDataFrame(places, "doc_id long, node int, at int")).collect()
    assert len(found) == len(places)
    for r in found:
        path, above = paths(texts[r.doc_id])
        link = path[r.node][1 : r.at]
        assert path[r.child].startswith(link) and len(path[r.parent]) <= len(link) < len(path[r.child]) and above[r.child] == r.parent
        assert r.exact == (0 if len(path[r.parent]) == len(link) else -1)


def brute_find(text, pattern):
    at = [i + 1 for i in range(len(text)) if text.startswith(pattern, i)]
    return len(at), at[0] if at else None


@pytest.mark.parametrize("block", [search.PATTERNS, 5])
def test_patterns(spark, monkeypatch, block):
    monkeypatch.setattr(search, "PATTERNS", block)
    r = random.Random(8)
    texts = ["abracadabra", "aaaa", "", "a$b$a", "".join(r.choice("ab ") for _ in range(300)), "kein Wort über Bäume \U0001f600 und über Bäume", "xabracadabrab"]
    wanted = ["a", "abra", "aaaaa", "aa", "$", "$a", "a$b$a", "über Bäume", "über Bäumen", "\U0001f600", "z", "ab a", "abracadabrab", "cadabra", "b$"] + ["".join(r.choice("ab ") for _ in range(r.randint(1, 12))) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(texts), (50, None)], SCHEMA)
    patterns = spark.createDataFrame([*enumerate(wanted), (None, "a"), (98, None), (99, "")], "pattern_id long, pattern string")
    found = {(x.doc_id, x.pattern_id): x for x in search.occurrences(df, patterns).collect()}
    walked = {(x.doc_id, x.pattern_id): x for x in search.walks(df, patterns).collect()}
    assert len(walked) == len(texts) * len(wanted)
    for d, t in enumerate(texts):
        path, above = paths(t)
        edges = [(path[c], path[p]) for c, p in above.items()]
        order = sorted(range(len(t) + 1), key=lambda i: t[i:] + "\U0010ffff")
        for k, p in enumerate(wanted):
            n, first = brute_find(t, p)
            assert ((d, k) in found) == (n > 0)
            w = walked[d, k]
            m = max(i for i in range(len(p) + 1) if p[:i] in t)
            assert w.matched == m
            x = found.get((d, k), w)
            if n:
                assert (x.n_occurrences, x.leftmost) == (n, first)
            q = p if n else p[:m]
            hit = [i for i, s in enumerate(order, 1) if t[s:].startswith(q)]
            assert (x.rank_lo, x.rank_hi) == (hit[0], hit[-1])
            if q:
                child, parent = next((c, u) for c, u in edges if len(u) < len(q) <= len(c) and c.startswith(q))
                assert (x.parent_depth, x.child_depth) == (len(parent), len(child))
                if m == len(p):
                    assert w.slow == (0 if len(child) == m else 2)
                elif len(child) == m:
                    assert w.slow == 0
                else:
                    letter = child[m] if child[m] != "\x00" else "\U0010ffff"
                    assert w.slow == (1 if letter > p[m] else -1)


def test_texts_with_a_pattern_s_first_words_alone_are_not_sorted():
    """A text is searched only if it has the first 16 characters of a pattern (or all of a shorter one, to a multiple of four)."""
    texts = ["of the greatest", "in of the great house", "of", "abcde", ""]
    chars, bounds = code_points(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    p = search.Patterns.of(np.array([1, 2, 3]), ["of the great house and", "of", "abcdef"])
    text, which = p.pairs(chars, doc, bounds[1:][doc])
    assert sorted(zip(text.tolist(), which.tolist())) == [(0, 1), (1, 0), (1, 1), (2, 1), (3, 2)]
    for width in (1, 2, 3, 4, 8, 12, 16):
        own = search.window_hashes(chars, width)
        same = {}
        for i in range(len(chars) - width + 1):
            same.setdefault(tuple(chars[i : i + width].tolist()), set()).add(int(own[i]))
        assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)
