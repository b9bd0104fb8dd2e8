import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.naive import implicit, tree
from textrine.operators import navigate, partitions, traverse, trees, windows
from textrine.options import Options, combinations
from textrine.plans.kernel import SuffixTrees
from textrine.queries import QUERIES, build

COLUMNS = ("parent", "parent_depth", "child", "child_depth", "suffix_link")

# hand-sized goldens: parent, parent depth, child, child depth, label
GOLDEN = {
    "a": [(1, 0, -1, 2, "a$"), (1, 0, -2, 1, "$")],
    "aaaa": [(1, 0, 4, 1, "a"), (4, 1, 3, 2, "a"), (3, 2, 2, 3, "a"), (2, 3, -1, 5, "a$"), (2, 3, -2, 4, "$"), (3, 2, -3, 3, "$"), (4, 1, -4, 2, "$"), (1, 0, -5, 1, "$")],
    "banana": [
        (1, 0, 4, 1, "a"), (4, 1, 2, 3, "na"), (2, 3, -2, 6, "na$"), (2, 3, -4, 4, "$"), (4, 1, -6, 2, "$"), (1, 0, -1, 7, "banana$"),
        (1, 0, 3, 2, "na"), (3, 2, -3, 5, "na$"), (3, 2, -5, 3, "$"), (1, 0, -7, 1, "$"),
    ],
}


def compare(texts):
    t = SuffixTrees(texts)
    e = t.edges()
    for d, text in enumerate(texts):
        at = e["doc"] == d
        want, nodes = tree(text)
        assert list(zip(*(e[k][at].tolist() for k in COLUMNS))) == [(*r[:4], r[5]) for r in want], text
        own = t.node_doc == d
        assert {i: (a, b) for i, a, b in zip(t.node_id[own].tolist(), t.depth[own].tolist(), t.head[own].tolist())} == nodes
        assert at.sum() == own.sum() + len(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé\U0001f600$\x7f\n", max_size=24), min_size=1, max_size=6))
def test_kernel_equals_enumeration(texts):
    compare(texts)


def test_kernel_on_many_random_texts():
    r = random.Random(3)
    compare(["", "a", "mississippi", "abcabxabcd", "abaababaabaab"] + ["".join(r.choices("ab", k=r.randint(0, 20))) for _ in range(300)])


def test_walks_that_are_cut_short(monkeypatch):
    from textrine.plans import kernel

    monkeypatch.setattr(kernel, "WALK", 2)
    compare(["a" * 40, "ab" * 20, "abc" * 9 + "ab", "", "mississippi"])


def test_counts_equal_the_trees(spark):
    r = random.Random(8)
    texts = ["", "a", "a" * 50, "ab" * 30] + ["".join(r.choices("abc", k=r.randint(0, 40))) for _ in range(60)]
    rows = trees.tree_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        nodes = tree(texts[row.doc_id])[1]
        n = len(texts[row.doc_id])
        assert (row.n, row.branching_nodes, row.edges, row.max_depth) == (n, len(nodes), len(nodes) + n, max(d for d, _ in nodes.values()))


def test_texts_are_dealt_only_if_there_are_few_bytes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "abcab" * (i % 7)) for i in range(200)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    plain = sorted(trees.suffix_array(texts).collect())
    assert trees.spread(texts) is texts  # too few to be worth it
    monkeypatch.setattr(trees, "LITTLE", 0)
    assert trees.spread(texts).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(trees.suffix_array(texts).collect()) == plain
    monkeypatch.setattr(trees, "SHARE", 0)
    assert trees.spread(texts) is texts


def test_prefix_partitions_equal_groups_of_suffixes(spark):
    r = random.Random(9)
    texts = ["", "a", "aaaa", "banana"] + ["".join(r.choices("ab\U0001f600", k=r.randint(0, 30))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for p in (0, 1, 2, 5):
        want = []
        for d, t in enumerate(texts):
            s = t + chr(0x10FFFF)
            groups: dict[str, list[int]] = {}
            for i in sorted(range(len(s)), key=lambda i: s[i:]):
                groups.setdefault(s[i : i + p], []).append(i)
            at = 1
            for k, own in enumerate(groups.values()):
                common = len(s) - own[0] if len(own) == 1 else len(os.path.commonprefix([s[i:] for i in own]))
                want.append((d, k, at, at + len(own), common, min(own) + 1))
                at += len(own)
        assert sorted(map(tuple, partitions.partitions(df, p).collect())) == want


def test_climbs_equal_a_walk(spark):
    texts = ["abcabxabcd", "aaaaaa", "", "abaababaabaab"]
    e = trees.edges(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for depth in (0, 1, 3):
        got = {(r.doc_id, r.node): (r.parent, r.child, r.exact) for r in navigate.go_up(e, depth).collect()}
        for d, t in enumerate(texts):
            above = {c: (p, pd) for p, pd, c, *_ in tree(t)[0]}
            for node in above:
                child = node
                while above[child][1] > depth:
                    child = above[child][0]
                assert got.pop((d, node)) == (above[child][0], child, 0 if above[child][1] == depth else -1)
        assert not got


def test_allocation(spark):
    from textrine.operators import memory

    rows = [(d, n, bn, n + bn) for d, (n, bn) in enumerate([(0, 1), (1, 1), (3, 2), (3, 3), (1000, 511), (1000, 512), (1000, 999), (5000, 4999)])]
    got = [r for r in memory.allocation(spark.createDataFrame(rows, "doc_id long, n long, branching_nodes long, edges long"), "SL").orderBy("doc_id").collect()]
    assert [r.node_records for r in got] == [0, 1, 3, 3, 512, 768, 1000, 5000]
    assert got[5].allocated_bytes == 1002 * 4 + 769 * 20 and got[5].node_load_percent == 100 * 512 / 768


def test_goldens_and_nulls(spark):
    texts = list(GOLDEN)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    got = trees.edges(df).orderBy("doc_id", "ord").collect()
    for i, t in enumerate(texts):
        assert [(r.parent, r.parent_depth, r.child, r.child_depth, r.label) for r in got if r.doc_id == i] == GOLDEN[t]
    assert [(r.parent, r.child, r.label) for r in got if r.doc_id == len(texts) + 1] == [(1, -1, "$")]
    assert not [r for r in got if r.doc_id == len(texts)]


def test_rendering(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "x" * 20 + "y" * 20)], "doc_id long, text string")
    e = trees.edges(df)
    simple = [r.line for r in traverse.log(e, False).where("doc_id = 1").orderBy("ord").collect()]
    assert simple[0] == "Simple suffix tree traversal BEGIN" and simple[-1] == "Simple suffix tree traversal END"
    assert simple[1] == 'P(?)[0]--"a"(1)-->C(?)[1]' and simple[3] == 'P(?)[3]--"na$"(3)-->C(-2)[6]'
    detailed = [r.line for r in traverse.log(e, True).where("doc_id = 1").orderBy("ord").collect()]
    assert detailed[1] == 'P(1)[0]--"a"(1)-->C(4)[1]{1}' and detailed[3] == 'P(2)[3]--"na$"(3)-->C(-2)[6]'
    long = [r.line for r in traverse.edge_lines(e, True).where("doc_id = 2").collect()]
    assert any('"xyyyyyyyyyyyyyy...' not in x and "..." not in x for x in long)
    lines = {r.i: r.line for r in traverse.suffix_lines(df).where("doc_id = 2").collect()}
    assert lines[1] == "1: " + "x" * 15 + "..." + "y" * 14 + "$ (41)" and lines[41] == "41: $ (1)" and "..." not in lines[10]


def test_every_combination_shows_the_same_tree(spark):
    df = spark.createDataFrame([(1, "mississippi")], "doc_id long, text string")
    shown = {tuple((r.label, r.child_depth) for r in build(df, o.checked()).orderBy("ord").collect()) for o in combinations()}
    assert len(combinations()) == 13 and len(shown) == 1


def test_options_that_do_not_go_together():
    import pytest

    for bad in (dict(layout="LA", algorithm="U"), dict(layout="SL", algorithm="P"), dict(layout="SL", algorithm="A", backward=True), dict(layout="SL", algorithm="M", collision="C"),
                dict(layout="SH", algorithm="M", hash_functions=4), dict(layout="SL", algorithm="U", prefix_length=2), dict(layout="SL", algorithm="U", benchmark="C", simple=True), dict(layout="SL", algorithm="M", window=True)):
        with pytest.raises(ValueError):
            Options(**bad).checked()


def test_navigation(spark):
    df = spark.createDataFrame([(1, "banana")], "doc_id long, text string")
    e = trees.edges(df)
    probes = spark.createDataFrame([(1, 1, "b"), (1, 1, "z")], "doc_id long, parent int, letter string")
    assert {(r.letter, r.child) for r in navigate.child_by_letter(e, probes).collect()} == {("b", -1), ("z", None)}
    assert {r.exact for r in navigate.locus(e, 1).where("node = 4").collect()} == {0}
    s = {r.pattern: (r.fast, r.matched, r.slow) for r in navigate.scans(e, ["ban", "q", "nz", "na", "banana!"]).collect()}
    assert s == {"ban": (0, 3, 2), "q": (2, 0, None), "nz": (0, 1, -1), "na": (0, 2, 0), "banana!": (0, 6, 1)}


def test_windows_equal_trees_from_scratch(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("ab", k=k)) for k in (1, 5, 6, 7, 12, 23)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    snaps = windows.snapshots(df, 3, 2)
    rows = windows.window_edges(snaps).collect()
    for s in snaps.collect():
        nodes, leaves = implicit(s.buffer)
        own = [x for x in rows if (x.doc_id, x.window_no) == (s.doc_id, s.window_no)]
        assert {x.path for x in own if x.leaf_start == 0} == nodes - {""}
        assert sorted(x.leaf_start for x in own if x.leaf_start) == [s.win_begin + i - 1 for i in leaves]
    for row in windows.window_stats(df, 6).collect():
        t = texts[row.doc_id]
        bn = [len(implicit(t[b : b + 6])[0]) for b in range(max(1, len(t) - 5))]
        assert (row.min_bn, row.max_bn, row.min_bn_at, row.max_bn_at) == (min(bn), max(bn), bn.index(min(bn)) + 1, bn.index(max(bn)) + 1)


def test_one_text_sorted_across_partitions(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/textrine-tests")
    text = "abracadabra" * 3
    got = [r.i for r in partitions.distributed_suffix_array(spark, text).orderBy("rank").collect()]
    assert got == sorted(range(1, len(text) + 2), key=lambda i: text[i - 1 :] + chr(0x10FFFF))


def test_classical_constructions():
    from textrine.plans import classical

    r = random.Random(12)
    texts = ["", "a", "aaaa", "mississippi", "abcabxabcd"] + ["".join(r.choices("abc"[:k], k=r.randint(1, 40))) for k in (1, 2, 3) for _ in range(20)]
    for t in texts:
        want = [e[4] for e in tree(t)[0]]
        for name, build_one in classical.BUILD.items():
            assert build_one(t).edges() == want, (name, t)


def test_invariance_sees_a_wrong_construction(spark, monkeypatch):
    """Each algorithm is really built: one that drops an edge of each text is counted."""
    from textrine import queries
    from textrine.operators import trees

    df = spark.createDataFrame([(1, "banana"), (2, "abab")], "doc_id long, text string")
    monkeypatch.setattr(queries, "names", lambda *_: df)
    assert {r.differing for r in queries.QUERIES["algorithm_invariance"](spark, "").collect()} == {0}
    right = trees.classical_edges
    monkeypatch.setattr(trees, "classical_edges", lambda texts, a: right(texts, a).where("ord > 1") if a == "U" else right(texts, a))
    got = {(r.layout, r.algorithm): r.differing for r in queries.QUERIES["algorithm_invariance"](spark, "").collect()}
    assert all(n == (2 if a == "U" else 0) for (_, a), n in got.items()) and len(got) == 13


def test_edges_are_not_broadcast(spark):
    """Spark takes a tree for as small as its text; a join of edges still has to stay off the driver."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "banana"), (2, "a$b$a")], "doc_id long, text string")
    e, n = trees.edges(df), trees.nodes(df)
    probes = n.select("doc_id", F.col("node_id").alias("parent"), F.lit("a").alias("letter"))
    asks = e.select("doc_id", F.col("child").alias("node"), F.lit(1).alias("depth"))
    snaps = windows.snapshots(df, 2, 2)
    for found in (navigate.child_by_letter(e, probes), navigate.go_up_each(e, asks), windows.evicted(windows.window_edges(snaps))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_climbs_without_a_shuffle(spark):
    """The climbs of whole texts are those of the window over their edges, and nothing is dealt again."""
    r = random.Random(31)
    texts = ["", "a", "aaaaaaaa", "mississippi", None] + ["".join(r.choices("abc", k=k)) for k in (3, 17, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for depth in (0, 1, 3):
        got = navigate.go_up_texts(df, depth)
        want = navigate.go_up(trees.edges(df, labels=False), depth)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_sort_is_by_eight_characters():
    """Short alphabets leave few suffixes for the rounds of doubling, whatever letters the table of codes spans."""
    from textrine.plans.kernel import code_points, packed_codes

    chars, bounds = code_points(["abracadabra", "日é😀 a"])
    doc = np.repeat(np.arange(2), np.diff(bounds))
    codes = packed_codes(chars, doc, bounds[1:][doc])
    assert len(codes) == 4 and len(set(codes[-1].tolist())) == len(chars)


def test_invariance_builds_each_tree_once(spark, monkeypatch):
    from textrine import queries

    df = spark.createDataFrame([(1, "banana"), (2, "abab")], "doc_id long, text string")
    monkeypatch.setattr(queries, "names", lambda *_: df)
    plan = queries.QUERIES["algorithm_invariance"](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 + len({o.checked().algorithm for o in combinations()})


def test_suffixes_of_one_row_group_and_one_long_text_go_to_many_tasks(spark, tmp_path):
    texts = ["a" * 100_000, "", None, "é\U0001f600$", "b" * (trees.PLACES - 1), "c" * trees.PLACES]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    rows = trees.leaves(spark.read.parquet(f"{tmp_path}/texts"))
    want = [(d, -i, len(t) + 2 - i) for d, t in enumerate(texts) if t is not None for i in range(1, len(t) + 2)]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "node_id": "int", "depth": "int"}
    shares = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 2 and max(shares) < 0.5 * len(want)


def test_packed_edges_need_fewer_bytes(spark, tmp_path):
    """The same rows in another order, and a file that is smaller by a tenth at least."""
    short = spark.createDataFrame([(1, "banana"), (2, "aaaa"), (None, "aab"), (None, ""), (7, None), (7, "x$"), (8, "é\U0001f600é")], "doc_id long, text string")
    for labels in (False, True):
        plain, packed = (trees.edges(short, labels=labels, packed=p) for p in (False, True))
        assert plain.schema == packed.schema
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, packed.collect()))
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    size = {}
    for name, df in {"plain": trees.edges(whole, labels=False), "packed": QUERIES["documents_edges"](spark, "/root/testdata/sf0.001")}.items():
        df.write.parquet(str(tmp_path / name))
        size[name] = sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))
    assert size["packed"] < 0.9 * size["plain"]
