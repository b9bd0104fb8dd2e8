"""Suffix arrays and trees of texts that are larger than a task.

A text lies in pieces (doc_id, seq, begin, piece). No task, group or driver holds
a text, its suffixes or its nodes; what a task holds is a slice of SPAN places.

Sorting: each suffix has its first characters packed in two longs, which pieces
and the start of the next one tell. Suffixes are sorted by range; those that are
still tied are sorted again by the rank of the suffix 2^k * KEY further, so that
repetitive texts take a round for each doubling of their longest repeat and other
texts few rounds over few suffixes. Tied suffixes of each round are kept: whether
two have one rank there tells whether that many characters are equal, which gives
common prefixes, over the bounds of ranges too.

Trees: a node is an interval of common prefixes that are not smaller, and its name
is (place of the last smaller one before it, depth). Places whose interval is open
at the end of their slice ask the slice where the minima of all slices say that it
closes. Parents, links and leftmost leaves are searches of the same kind and joins
on places; ids and the traversal's order are numbers of a sort by range.

Defined results: as the kernel's. Null texts are left out, and rows with a null
id, which cannot name a text's pieces; two texts with one id are an error, as their
pieces cannot be told apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.plans.kernel import END
from textrine.plans.ranges import Blocks, Both, Minima, ordered, unpacked
from textrine.sources.scratch import Scratch

#: Characters of a piece, places of a slice, rows for each task of a sort.
PIECE, SPAN, ROWS = 1 << 20, 1 << 18, 1 << 20


def pieces(texts: DataFrame, size: int = 0) -> DataFrame:
    """doc_id, seq, begin (from 0), piece: each text cut once, in linear time."""
    import pyarrow as pa

    size = size or PIECE
    schema = "doc_id long, seq long, begin long, piece string"

    def cut(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(max(1, -(-len(text) // size))):
                    row = [[doc_id], [k], [k * size], [text[k * size : (k + 1) * size]]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in row[:3]), pa.array(row[3], pa.string())], ["doc_id", "seq", "begin", "piece"])

    return texts.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(cut, schema)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(cut: DataFrame) -> np.ndarray:
    """The different characters of all pieces, in order: a few hundred, and as many as Unicode has at most."""
    import pyarrow as pa

    def seen(batches):
        have = np.zeros(END, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                have[points(t)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(have).astype(np.int32))], ["c"])

    return np.sort(cut.select("piece").mapInArrow(seen, "c int").distinct().toPandas()["c"].to_numpy(np.int64))


class Index:
    """Suffix array, nodes and edges of a relation of pieces; tables are made once, in a scratch folder that ``drop`` removes."""

    def __init__(self, cut: DataFrame, span: int = 0, rows: int = 0):
        spark = cut.sparkSession
        self.scratch = Scratch(spark, "index")
        self.span = span or SPAN
        cut = self.scratch.keep(cut, "pieces")
        size = cut.agg(F.sum(F.length("piece")), F.count_distinct("doc_id"), F.count_if(F.col("seq") == 0)).first()
        if size[1] != size[2]:
            raise ValueError("two texts have one id")
        self.n = (size[0] or 0) + size[1]  # suffixes, terminators included
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.n // (rows or ROWS))
        self._sort(cut)
        self._measure()
        self.blocks = Blocks(self.array, ["doc_id", "i", "lcp"], self.span, self.parts, self.scratch, "slices")
        self._nodes = self._places = None

    def _ordered(self, df, by, levels, name):
        return ordered(df, by, levels, self.parts, self.scratch, name)

    def _sort(self, cut: DataFrame) -> None:
        import pyarrow as pa

        letters = alphabet(cut)
        self.bits = bits = max(1, int(len(letters) + 1).bit_length())
        self.half = half = 62 // bits
        self.key = key = 2 * half
        code = np.zeros(END + 1, np.int64)
        code[letters] = np.arange(1, len(letters) + 1)
        code[END] = len(letters) + 1
        code = cut.sparkSession.sparkContext.broadcast(code)  # one number for each character of Unicode

        after = cut.select("doc_id", (F.col("seq") - 1).alias("seq"), F.substring("piece", 1, key).alias("ahead"), F.length("piece").alias("left"))
        joined = cut.join(after, ["doc_id", "seq"], "left").select("doc_id", "begin", "piece", "ahead", "left")

        def keyed(batches):
            for batch in batches:
                for doc_id, begin, piece, ahead, left in zip(*(c.to_pylist() for c in batch.columns)):
                    last = ahead is None
                    own = points(piece).astype(np.int64)
                    chars = np.concatenate([own, points(ahead or ""), [END] if last or left < key else []]).astype(np.int64)
                    n = len(own) + last
                    codes = np.concatenate([code.value[chars], np.zeros(key, np.int64)])
                    packed = []
                    for lo in (0, half):
                        k = np.zeros(n, np.int64)
                        for j in range(lo, lo + half):
                            k = (k << bits) | codes[j : j + n]
                        packed.append(k)
                    i = begin + 1 + np.arange(n)
                    for a in range(0, n, 200_000):
                        some = slice(a, a + 200_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[some]), doc_id)), pa.array(i[some]), *(pa.array(p[some]) for p in packed)], ["doc_id", "i", "k1", "k2"])

        first = joined.mapInArrow(keyed, "doc_id long, i long, k1 long, k2 long")
        sorted_ = self._ordered(first, ["doc_id", "k1", "k2", "i"], [["doc_id"], ["doc_id", "k1", "k2"]], "sorted")
        now = sorted_.select("doc_id", "i", "k1", "k2", F.col("run0").alias("origin"), F.col("run1").alias("rank0"), F.col("run1").alias("rank"), "tied")
        self.keys = now.select("doc_id", "i", "k1", "k2")
        settled, tied = [now.where("NOT tied")], now.where("tied")
        self.levels, h = [], key
        while not tied.isEmpty():
            self.levels.append((h, tied.select("doc_id", "i", "rank")))
            known = tied
            for x in settled:
                known = known.union(x)
            ahead = known.select("doc_id", (F.col("i") - h).alias("i"), F.col("rank").alias("next"))
            again = self._ordered(tied.drop("tied").join(ahead, ["doc_id", "i"]), ["rank", "next", "i"], [["rank"], ["rank", "next"]], f"tied{h}")
            placed = again.withColumn("rank", F.col("rank") + F.col("run1") - F.col("run0")).select(now.columns)
            settled.append(placed.where("NOT tied"))
            tied, h = placed.where("tied"), 2 * h
        whole = settled[0]
        for x in settled[1:]:
            whole = whole.union(x)
        self.sorted = whole.withColumnRenamed("rank", "pos").drop("tied")

    def _common(self, a1, a2, b1, b2) -> str:
        """SQL: equal leading characters of two packed keys."""
        same = lambda x, y: f"({self.half} - CAST(ceil(length(bin({x} ^ {y})) / {self.bits}D) AS INT))"
        return f"CASE WHEN {a1} != {b1} THEN {same(a1, b1)} WHEN {a2} != {b2} THEN {self.half} + {same(a2, b2)} ELSE {self.key} END"

    def _measure(self) -> None:
        before = self.sorted.select((F.col("pos") + 1).alias("pos"), F.col("doc_id").alias("pdoc"), F.col("i").alias("j"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rank0").alias("prank"))
        pairs = self.scratch.keep(self.sorted.join(before, "pos", "left"), "pairs")
        other = "pdoc IS NULL OR pdoc != doc_id"
        near = pairs.where(f"{other} OR rank0 != prank").select("pos", "doc_id", "i", "origin", F.expr(f"CASE WHEN {other} THEN -1 ELSE {self._common('k1', 'k2', 'p1', 'p2')} END").cast("long").alias("lcp"))
        deep = pairs.where("pdoc = doc_id AND rank0 = prank").select("pos", "doc_id", "i", "origin", F.col("i").alias("x"), F.col("j").alias("y"), F.lit(0).cast("long").alias("lcp"))
        for n, (h, tied) in enumerate(reversed(self.levels)):
            at = lambda c, rank: tied.select("doc_id", F.col("i").alias(c), F.col("rank").alias(rank))  # noqa: E731, B023
            met = deep.join(at("x", "rx"), ["doc_id", "x"], "left").join(at("y", "ry"), ["doc_id", "y"], "left")
            step = F.when(F.col("rx") == F.col("ry"), h).otherwise(0)
            deep = met.select("pos", "doc_id", "i", "origin", (F.col("x") + step).alias("x"), (F.col("y") + step).alias("y"), (F.col("lcp") + step).alias("lcp"))
            if n % 4 == 3:
                deep = self.scratch.keep(deep, f"equal{h}")
        key = lambda c, a, b: self.keys.select("doc_id", F.col("i").alias(c), F.col("k1").alias(a), F.col("k2").alias(b))
        told = deep.join(key("x", "a1", "a2"), ["doc_id", "x"]).join(key("y", "b1", "b2"), ["doc_id", "y"])
        far = told.select("pos", "doc_id", "i", "origin", (F.col("lcp") + F.expr(self._common("a1", "a2", "b1", "b2"))).alias("lcp"))
        self.array = self.scratch.keep(near.union(far), "array")

    def suffix_array(self) -> DataFrame:
        """doc_id, rank (from 1), i, lcp with the suffix one rank before (0 for the first), as ``trees.suffix_array``."""
        return self.array.select("doc_id", (F.col("pos") - F.col("origin") + 1).alias("rank"), "i", F.greatest("lcp", F.lit(0)).alias("lcp"))

    def places(self) -> DataFrame:
        """pos, doc_id, i, lcp, up, and of the node at each place (lcp >= 0): left, left_lcp, right, right_lcp.

        ``up``: the place whose node is above the leaf here. The first place of a text
        has lcp -1 and no node, but that of an empty text the root's.
        """
        if self._places is not None:
            return self._places
        import pyarrow as pa

        blocks, span, n, columns = self.blocks, self.span, self.n, self.blocks.columns
        lows, heads = Both(blocks.least["lcp"]), np.append(blocks.first["lcp"], -1)
        names = ["pos", "doc_id", "i", "lcp", "up", "left", "left_lcp", "right", "right_lcp", "left_rid", "right_rid"]

        def local(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    b, rid = unpacked(row, columns), row["rid"]
                    lcp, m, base = b["lcp"], len(b["lcp"]), row["rid"] * span
                    behind = np.append(lcp[1:], heads[rid + 1])
                    at, both = np.arange(m), Both(lcp)
                    left, right = both.before(at - 1, lcp), both.after(np.minimum(at + 1, m - 1), lcp)
                    right[-1] = m
                    bare = (lcp < 0) & (behind < 0)
                    left[bare], right[bare] = at[bare], at[bare] + 1
                    depth = np.where(bare, 0, lcp)
                    real = depth >= 0
                    open_left, open_right = real & (left < 0), real & (right >= m) & ~bare
                    left_rid = np.where(open_left, lows.before(np.full(m, rid - 1), lcp), -1)
                    right_rid = np.where(open_right, lows.after(np.full(m, rid + 1), lcp) if rid + 1 < lows.n else lows.n, -1)
                    ended = right_rid >= lows.n  # nothing smaller comes
                    has_left, has_right = real & ~open_left, (real & ~open_right) | ended
                    out = [
                        base + at, b["doc_id"], b["i"], depth, base + np.where(bare | (lcp >= behind), at, at + 1),
                        (base + left, has_left), (np.where(bare, -1, lcp[np.clip(left, 0, m - 1)]), has_left),
                        (np.where(ended, n, base + right), has_right), (np.where(ended | bare | (right >= m), -1, lcp[np.clip(right, 0, m - 1)]), has_right),
                        (left_rid, left_rid >= 0), (np.where(ended, -1, right_rid), (right_rid >= 0) & ~ended),
                    ]
                    arrays = [pa.array(c[0], mask=~c[1]) if isinstance(c, tuple) else pa.array(c) for c in out]
                    for a in range(0, m, 100_000):
                        yield pa.RecordBatch.from_arrays([x[a : a + 100_000] for x in arrays], names)

        def last_below(block, low):
            found = Minima(block["lcp"]).before(np.full(len(low), len(block["lcp"]) - 1), low)
            return found, block["lcp"][found]

        def first_below(block, low):
            found = Both(block["lcp"]).after(np.zeros(len(low), int), low)
            return found, block["lcp"][found]

        found = self.scratch.keep(blocks.rows.select("rid", "doc_id", "i", "lcp").mapInArrow(local, ", ".join(f"{c} long" for c in names)), "local")
        for side, answer in (("left", last_below), ("right", first_below)):
            rest = found.where(f"{side}_rid IS NOT NULL").withColumn("rid", F.col(f"{side}_rid"))
            told = blocks.asked(rest, ["lcp"], answer, "_found long, _value long")
            told = told.withColumns({side: F.col("rid") * span + F.col("_found"), f"{side}_lcp": F.col("_value"), f"{side}_rid": F.lit(None).cast("long")}).select(names)
            found = self.scratch.keep(found.where(f"{side}_rid IS NULL").union(told), f"closed-{side}")
        self._places = found.drop("left_rid", "right_rid")
        return self._places

    def _leftmost(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with first: the least start among the leaves below (places left to right - 1)."""
        span, least = self.span, Minima(self.blocks.least["i"])
        lo, hi = F.expr(f"left div {span}L"), F.expr(f"(right - 1) div {span}L")
        ends = nodes.select("left", "depth", "right", lo.alias("a"), hi.alias("b"))
        first, last = F.col("left") % span, (F.col("right") - 1) % span
        one = F.struct(F.col("a").alias("rid"), first.alias("lo"), F.when(F.col("a") == F.col("b"), last).otherwise(F.lit(span - 1)).alias("hi"))
        two = F.struct(F.col("b").alias("rid"), F.lit(0).cast("long").alias("lo"), last.alias("hi"))
        asks = ends.withColumn("ask", F.explode(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, two)))).select("left", "depth", "a", "b", "ask.*")
        told = self.blocks.asked(asks, ["lo", "hi"], lambda block, lo, hi: (Minima(block["i"]).minimum(lo, hi),), "least long")
        most = np.iinfo(np.int64).max

        @F.pandas_udf("long")
        def between(a: pd.Series, b: pd.Series) -> pd.Series:
            a, b = a.to_numpy() + 1, b.to_numpy() - 1
            out, some = np.full(len(a), most), a <= b
            out[some] = least.minimum(a[some], b[some])
            return pd.Series(out)

        firsts = told.groupBy("left", "depth").agg(F.min(F.least("least", between("a", "b"))).alias("first"))
        return nodes.join(firsts, ["left", "depth"])

    def _tree(self) -> tuple[DataFrame, DataFrame]:
        """Nodes with ids, and children (of both kinds) with their parent's name; each written once."""
        if self._nodes is not None:
            return self._nodes
        keep, places = self.scratch.keep, self.places()
        of_node = places.where("lcp >= 0").groupBy("left", F.col("lcp").alias("depth")).agg(F.min("pos").alias("at"), *(F.first(c).alias(c) for c in ("doc_id", "right", "left_lcp", "right_lcp")))
        plain = keep(self._leftmost(of_node), "plain")
        inner = plain.where("depth > 0").select("doc_id", F.expr("CASE WHEN left_lcp >= right_lcp THEN left ELSE right END").alias("pos"), F.col("left").alias("place"), "depth", "first", F.lit(False).alias("is_leaf"))
        sizes = self.array.groupBy("doc_id").agg(F.max("i").alias("size"))
        leaves = places.join(sizes, "doc_id").select("doc_id", F.col("up").alias("pos"), F.col("pos").alias("place"), (F.col("size") + 1 - F.col("i")).alias("depth"), F.col("i").alias("first"), F.lit(True).alias("is_leaf"))
        name = places.select("pos", F.col("left").alias("parent_left"), F.col("lcp").alias("parent_depth"))
        children = keep(inner.union(leaves).join(name, "pos").drop("pos"), "children")
        two = F.slice(F.array_sort(F.collect_list("first")), 1, 2)  # a node has no more children than there are letters
        heads = children.groupBy(F.col("parent_left").alias("left"), F.col("parent_depth").alias("depth")).agg(two.alias("two"), F.count("*").cast("int").alias("n_children"))
        headed = plain.join(heads, ["left", "depth"]).withColumn("head", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.col("two")[1])).drop("two")
        named = self._ordered(headed, ["doc_id", "head"], [["doc_id"]], "named").withColumn("node_id", (F.col("pos") - F.col("run0") + 1).cast("int")).drop("pos", "run0", "tied")
        # the node of the suffix that follows: the last common prefix under this depth, up to the follower's place
        here = named.where("depth > 0").join(self.array.select(F.col("pos").alias("at"), "i"), "at")
        follower = here.select("left", "depth", "doc_id", (F.col("i") + 1).alias("i")).join(self.array.select("doc_id", "i", "pos"), ["doc_id", "i"])
        met = self.blocks.below_before(follower, "lcp", "pos", "depth", self.scratch, "links").select("left", "depth", F.col("found").alias("pos"))
        target = met.join(name, "pos").select("left", "depth", "parent_left", "parent_depth")
        ids = named.select(F.col("left").alias("parent_left"), F.col("depth").alias("parent_depth"), F.col("node_id").alias("suffix_link"))
        links = target.join(ids, ["parent_left", "parent_depth"]).select("left", "depth", "suffix_link")
        nodes = keep(named.join(links, ["left", "depth"], "left").withColumn("suffix_link", F.coalesce("suffix_link", F.lit(0))), "nodes")
        self._nodes = nodes, children
        return self._nodes

    def nodes(self) -> DataFrame:
        """As ``trees.nodes``."""
        nodes, children = self._tree()
        up = children.where("NOT is_leaf").select(F.col("place").alias("left"), "depth", "parent_left", "parent_depth")
        ids = nodes.select(F.col("left").alias("parent_left"), F.col("depth").alias("parent_depth"), F.col("node_id").alias("parent"))
        found = nodes.join(up.join(ids, ["parent_left", "parent_depth"]).select("left", "depth", "parent"), ["left", "depth"], "left")
        return found.select("doc_id", "node_id", "depth", F.col("head").alias("head_position"), F.col("first").alias("leftmost"), "suffix_link", F.coalesce("parent", F.lit(0)).alias("parent"), "n_children")

    def edges(self) -> DataFrame:
        """As ``trees.edges`` without labels."""
        nodes, children = self._tree()
        own = nodes.select(F.col("left").alias("place"), "depth", "node_id", "head", "suffix_link", F.lit(False).alias("is_leaf"))
        ids = nodes.select(F.col("left").alias("parent_left"), F.col("depth").alias("parent_depth"), F.col("node_id").alias("parent"))
        met = children.join(own, ["place", "depth", "is_leaf"], "left").join(ids, ["parent_left", "parent_depth"])
        child = F.when(F.col("is_leaf"), -F.col("first")).otherwise(F.col("node_id"))
        leaf = F.col("is_leaf").cast("int").alias("leaf")
        rows = met.select("doc_id", "place", leaf, "parent", "parent_depth", child.alias("child"), F.col("depth").alias("child_depth"), F.coalesce("suffix_link", F.lit(0)).alias("suffix_link"), F.when(F.col("is_leaf"), F.col("first")).otherwise(F.col("head")).alias("start"))
        numbered = self._ordered(rows, ["doc_id", "place", "leaf", "child_depth"], [["doc_id"]], "edges")
        return numbered.select("doc_id", (F.col("pos") - F.col("run0") + 1).alias("ord"), "parent", "parent_depth", "child", "child_depth", "suffix_link", "start", (F.col("child_depth") - F.col("parent_depth")).alias("label_len"))

    def drop(self) -> None:
        self.scratch.drop()
