"""Suffixes, suffix arrays, nodes and edges of texts, as DataFrames.

Whole texts are indexed by the array kernel in ``mapInArrow``: a task takes the
texts of an Arrow batch some hundred thousand characters at a time, so that memory does not
depend on the number of texts, no suffix is shuffled, and texts of any length are
indexed in full. Which of the classical constructions a caller names (simple or
linked McCreight, simple or linked Ukkonen, partition and write-only) has no
influence on the tree, only on what is shown of it; see ``options``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.plans.kernel import SuffixArrays, SuffixTrees, slices, smaller_before

#: Bytes of text a core, by Spark's estimate, under which texts are dealt to all cores; and bytes that are not worth it.
SHARE, LITTLE = 64 << 20, 1 << 20
#: Suffixes of a text that are unfolded from one row; and bytes of text, by Spark's estimate, whose suffixes one task unfolds.
PLACES, UNFOLDED = 1 << 14, 2 << 20


def size_of(texts: DataFrame) -> int:
    """Bytes of a table by Spark's estimate."""
    return int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def suffixes(texts: DataFrame) -> DataFrame:
    """doc_id, i, suffix_len: every suffix, with the terminator; 1..n+1.

    Texts become rows of up to PLACES suffixes, which are dealt to all cores before
    they are unfolded: neither a file of few row groups nor a long text is one task's
    work, and only ids and lengths are shuffled.
    """
    n = F.length("text")
    runs = texts.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(1), n + 1, F.lit(PLACES))).alias("first"))
    cores, size = texts.sparkSession.sparkContext.defaultParallelism, size_of(texts)
    tasks = max(4 * cores, size // UNFOLDED if size < 1 << 60 else 0)
    last = F.least(F.col("first") + (PLACES - 1), F.col("n") + 1)
    rows = runs.repartition(tasks).sortWithinPartitions("n", "first").select("doc_id", "n", F.explode(F.sequence("first", last)).alias("i"))
    return rows.select("doc_id", "i", (F.col("n") + 2 - F.col("i")).alias("suffix_len"))


def leaves(texts: DataFrame) -> DataFrame:
    """doc_id, node_id, depth: the leaf of each suffix; the depth counts the terminator."""
    return suffixes(texts).select("doc_id", (-F.col("i")).alias("node_id"), F.col("suffix_len").alias("depth"))


def spread(texts: DataFrame) -> DataFrame:
    """``texts`` dealt to all cores if there are few bytes of them for each.

    A Parquet file is read by as many tasks as it has row groups, which may be one,
    and a tree takes far longer than moving its text. Large tables are left as they are read.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    size = size_of(texts)
    return texts.repartition(4 * cores, "doc_id", "text") if LITTLE <= size < SHARE * cores else texts


def per_batch(texts: DataFrame, make, schema: str, by_length: bool = False) -> DataFrame:
    """``make(texts)`` -> dict of arrays with ``doc`` (text number) for groups of texts, with ``by_length`` of similar length.

    Ids are carried as they are: a text with a null id is indexed like any other and its
    rows have a null id, and each of two texts with one id has its own rows. Operators
    that join or group on ids need ids that tell texts apart.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    types = {f.split()[0]: kinds[f.split()[1]] for f in (x.strip() for x in schema.split(","))}

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t) + 1 for t in rows]):
                out = make(rows[a:b])
                doc_ids = ids[a:b].take(pa.array(out.pop("doc")))
                n = len(doc_ids)
                for lo in range(0, max(n, 1), 200_000):
                    part = {"doc_id": doc_ids, **out}
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := part[k][lo : lo + 200_000], pa.Array) else pa.array(x, types[k]) for k in names], names)

    dealt = spread(texts.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()))
    return (dealt.sortWithinPartitions(F.length("text")) if by_length else dealt).mapInArrow(run, schema)


def suffix_array(texts: DataFrame) -> DataFrame:
    """doc_id, rank (from 1), i, lcp with the suffix one rank before (0 for the first)."""

    def make(rows):
        sa = SuffixArrays(rows)
        return {"doc": sa.doc, "rank": np.arange(len(sa.doc)) - sa.bounds[sa.doc] + 1, "i": sa.start, "lcp": np.maximum(sa.lcp, 0)}

    return per_batch(texts, make, "doc_id long, rank int, i int, lcp int")


def nodes(texts: DataFrame) -> DataFrame:
    """Branching nodes: id in creation order, depth, head position, link, parent, children.

    The root has id 1, head 0 and no parent or link (0).
    """

    def make(rows):
        t = SuffixTrees(rows)
        other = lambda x: np.where(x >= 0, t.node_id[x], 0)
        return {"doc": t.node_doc, "node_id": t.node_id, "depth": t.depth, "head_position": t.head, "leftmost": t.first, "suffix_link": other(t.link), "parent": other(t.parent), "n_children": t.children}

    return per_batch(texts, make, "doc_id long, node_id int, depth int, head_position int, leftmost int, suffix_link int, parent int, n_children int")


def edges(texts: DataFrame, labels: bool = True, packed: bool = False) -> DataFrame:
    """Edges in traversal order: parent and child with depths, label, suffix link.

    ``packed`` is for tables that are written: rows of a group of texts of similar length come by
    child, so that columnar files need fewer bytes for them; ``ord`` has the traversal's order.

    Labels end with "$" at leaves, which is how the terminator is shown; an edge is the
    terminator alone if it leads to a leaf one deeper, whatever letters the text has. Without ``labels`` only their length is made,
    which keeps the output linear in the text.
    """

    def make(rows):
        e = SuffixTrees(rows).edges()
        out = {k: e[k] for k in ("doc", "ord", "parent", "parent_depth", "child", "child_depth", "suffix_link", "start")}
        out["label_len"] = e["child_depth"] - e["parent_depth"]
        if packed:
            order = np.lexsort((out["doc"], np.abs(out["child"]), out["child"] < 0))
            out = {k: x[order] for k, x in out.items()}
        if labels:
            ended = [t + "$" for t in rows]
            a = out["start"] - 1 + out["parent_depth"]
            out["label"] = [ended[d][x:y] for d, x, y in zip(out["doc"].tolist(), a.tolist(), (a + out["label_len"]).tolist())]
        return out

    schema = "doc_id long, ord int, parent int, parent_depth int, child int, child_depth int, suffix_link int, start int, label_len int"
    out = per_batch(texts, make, schema + (", label string" if labels else ""), by_length=packed)
    return out.withColumn("letter", F.substring("label", 1, 1)) if labels else out


def classical_edges(texts: DataFrame, algorithm: str) -> DataFrame:
    """doc_id, ord, label as the named algorithm itself makes them, letter by letter: for short texts."""
    from textrine.plans.classical import BUILD

    def make(rows):
        found = [BUILD[algorithm](t).edges() for t in rows]
        sizes = [len(f) for f in found]
        return {"doc": np.repeat(np.arange(len(rows)), sizes), "ord": [k for n in sizes for k in range(1, n + 1)], "label": [x for f in found for x in f]}

    return per_batch(texts, make, "doc_id long, ord int, label string")


def tree_counts(texts: DataFrame) -> DataFrame:
    """doc_id, n, branching_nodes, edges, max_depth: one row per text, from its suffix array without making nodes."""

    def make(rows):
        sa = SuffixArrays(rows)
        n = np.diff(sa.bounds) - 1
        # a node for each first of its value among neighbours that are not smaller; a text without characters has a root
        first = (sa.lcp >= 0) & (sa.lcp[smaller_before(sa.lcp, equal=True)] < sa.lcp)
        nodes_of = np.bincount(sa.doc[first], minlength=len(rows)) + (n == 0)
        deepest = np.maximum.reduceat(np.maximum(sa.lcp, 0), sa.bounds[:-1])
        return {"doc": np.arange(len(rows)), "n": n, "branching_nodes": nodes_of, "edges": nodes_of + n, "max_depth": deepest}

    return per_batch(texts, make, "doc_id long, n long, branching_nodes long, edges long, max_depth long")
