"""Sliding windows over texts: snapshots, implicit trees, per-slide statistics.

A window's tree has no terminator: a node branches if two different characters
follow it inside the window, and a suffix is a leaf if it occurs once in it. It
is had from the window's full tree by leaving out nodes whose second child is
only the terminator, and leaves that end on a node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.operators.trees import per_batch
from textrine.plans.kernel import SuffixTrees, slices
from textrine.plans.sweep import STARTS, of_long_text, slides, swept
from textrine.sources.blocks import cut

def snapshots(texts: DataFrame, block: int, active: int) -> DataFrame:
    """Windows at block boundaries: full active part, moved by a block, last one at the end.

    A text shorter than the active part has one window that is not full.
    """
    size, n = block * active, F.length("text")
    moves = F.greatest(F.lit(0), F.ceil((n - size) / block)).cast("int")
    # blocks are cut once; a window is ``active`` of them end to end, so that time and rows grow with the windows alone
    pieces = texts.where(n > 0).select("doc_id", n.alias("n"), moves.alias("moves"), cut(F.col("text"), block).alias("pieces"))
    windows = F.expr(f"transform(sequence(0, moves), k -> struct(k AS window_no, array_join(slice(pieces, k + 1, {active}), '') AS buffer))")
    rows = pieces.select("doc_id", "n", F.inline(windows))
    begin = F.col("window_no") * block + 1
    end = F.least(begin + size - 1, F.col("n"))
    return rows.select("doc_id", "window_no", begin.alias("win_begin"), end.alias("win_end"), (end - begin + 1).alias("win_len"), (F.col("n") >= size).alias("is_full"), "buffer")


def implicit(t: SuffixTrees):
    """Which nodes and leaves of full trees stay in the trees without terminator.

    Returns (node kept, kept node at or above each node, suffix kept); suffixes are in sorted order.
    """
    sa = t.sa
    depth = sa.end[sa.order] - sa.order  # of the leaf, terminator included
    bare = t.depth[t.leaf_parent] == depth - 1  # the edge is the terminator alone
    ends = np.zeros(len(t.depth), np.int64)
    np.add.at(ends, t.leaf_parent[bare], 1)
    kept = (t.depth == 0) | (t.children - ends >= 2)
    up = np.where(kept, np.arange(len(kept)), np.maximum(t.parent, 0))
    while True:
        further = up[up]
        if (further == up).all():
            return kept, up, ~bare
        up = further


def window_edges(snaps: DataFrame) -> DataFrame:
    """Edges of each snapshot's tree by path: parent depth, child depth, label, leaf start.

    ``leaf_slot`` is the circular slot of the leaf's start, 0 for branching nodes.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, (no, begin, rows) = batch.column(0), (c.to_pylist() for c in batch.columns[1:])
            for lo, hi in slices([len(x) + 1 for x in rows]):
                some = rows[lo:hi]
                t = SuffixTrees(some)
                sa = t.sa
                kept, up, leaf = implicit(t)
                inner = np.flatnonzero(kept & (t.parent >= 0))
                outer = np.flatnonzero(leaf)
                doc = np.concatenate([t.node_doc[inner], sa.doc[sa.order[outer]]])
                top = t.depth[up[np.concatenate([t.parent[inner], t.leaf_parent[outer]])]]
                start = np.concatenate([t.head[inner], sa.start[outer]])
                depth = np.concatenate([t.depth[inner], (sa.end[sa.order] - sa.order - 1)[outer]])
                is_leaf = np.arange(len(doc)) >= len(inner)
                label = [some[d][s - 1 + a : s - 1 + b] for d, s, a, b in zip(doc.tolist(), start.tolist(), top.tolist(), depth.tolist())]
                path = [some[d][s - 1 : s - 1 + b] for d, s, b in zip(doc.tolist(), start.tolist(), depth.tolist())]
                first = np.array(begin[lo:hi])[doc]
                yield pa.RecordBatch.from_arrays([
                    ids[lo:hi].take(pa.array(doc)), pa.array(np.array(no[lo:hi])[doc], pa.int32()), pa.array(path, pa.string()),
                    pa.array(top, pa.int32()), pa.array(depth, pa.int32()), pa.array(label, pa.string()), pa.array(np.where(is_leaf, first + start - 1, 0), pa.int32()),
                ], ["doc_id", "window_no", "path", "parent_depth", "child_depth", "label", "leaf_start"])

    return snaps.select("doc_id", "window_no", "win_begin", "buffer").mapInArrow(run, "doc_id long, window_no int, path string, parent_depth int, child_depth int, label string, leaf_start int")


def counted(count, rows: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``count`` (of ``plans.sweep``) of each text, long ones by parts."""
    short = [d for d, t in enumerate(rows) if len(t) <= STARTS]
    found = dict(zip(short, count([rows[d] for d in short], size))) if short else {}
    return [found[d] if d in found else of_long_text(count, t, size) for d, t in enumerate(rows)]


def window_slides(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, slide, shortened_to, merged_depth: what each slide takes from the window's tree, before the next letter comes.

    The slide from the window at ``slide`` (from 1) takes the leaf of that start. If the
    window's longest repeated suffix has no other occurrence left, the leaf is shortened
    instead and becomes that of ``shortened_to``; else a node that is left with one child
    is merged, which has ``merged_depth``. Null where there is none.
    """

    def make(rows):
        found = counted(slides, rows, size)
        sizes = [len(x) for x, _ in found]
        leaf, depth = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        import pyarrow as pa

        doc = np.repeat(np.arange(len(rows)), sizes)
        slide = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        nullable = lambda x, y: pa.array(x.astype(np.int64), mask=y < 0)
        return {"doc": doc, "slide": slide, "shortened_to": nullable(leaf + 1, leaf), "merged_depth": nullable(depth, depth)}

    return per_batch(texts.where(F.length("text") > 0), make, "doc_id long, slide long, shortened_to long, merged_depth long")


def window_stats(texts: DataFrame, size: int) -> DataFrame:
    """Least, mean and greatest node and edge counts over all windows of a text, with first positions.

    All slides are counted by one sweep over the text's tree (``plans.sweep``): no window
    has a tree of its own, and memory does not depend on the window's size.
    """

    def make(rows):
        out = {k: [] for k in ("doc", "n", "observations", "min_bn", "min_bn_at", "avg_bn", "max_bn", "max_bn_at", "min_edges", "min_edges_at", "avg_edges", "max_edges", "max_edges_at")}
        for d, (t, (bn, leaves)) in enumerate(zip(rows, counted(swept, rows, size))):
            row = [d, len(t), len(bn)]
            for x in (bn, bn - 1 + leaves):
                row += [int(x.min()), int(x.argmin()) + 1, float(x.sum()) / len(x), int(x.max()), int(x.argmax()) + 1]
            for name, value in zip(out, row):
                out[name].append(value)
        out["doc"] = np.array(out["doc"], np.int64)
        return out

    schema = "doc_id long, n long, observations long, " + ", ".join(f"min_{x} long, min_{x}_at long, avg_{x} double, max_{x} long, max_{x}_at long" for x in ("bn", "edges"))
    return per_batch(texts.where(F.length("text") > 0), make, schema)


def evicted(edges: DataFrame) -> DataFrame:
    """Nodes and leaves of one snapshot that the next no longer has, by path."""
    following = edges.select("doc_id", (F.col("window_no") - 1).alias("window_no"), "path", "leaf_start")
    last = edges.groupBy("doc_id").agg(F.max("window_no").alias("last"))
    current = edges.join(last.hint("merge"), "doc_id")  # sizes that Spark estimates by the texts, as in ``navigate``
    current = current.where("window_no < last").select("doc_id", "window_no", "path", "leaf_start")
    return current.join(following.hint("merge"), ["doc_id", "window_no", "path", "leaf_start"], "left_anti")


def leaf_arithmetic(snaps: DataFrame, block: int, active: int, total: int) -> DataFrame:
    """Depth, circular offset, slot and depth order of each start in a window."""
    size, ring = block * active, block * total
    rows = snaps.select("doc_id", "window_no", "win_begin", "win_end", F.explode(F.sequence("win_begin", "win_end")).alias("start"))
    return rows.select(
        "doc_id", "window_no", "start", (F.col("win_end") - F.col("start") + 1).alias("leaf_depth"), (F.pmod(F.col("start") - 1, F.lit(ring)) + 1).alias("sw_offset"),
        (F.pmod(F.col("start") - 1, F.lit(size)) + 1).alias("slot"), F.pmod(F.col("start") - F.col("win_begin"), F.lit(ring)).alias("depth_order"),
    )


def offset_valid(rows: DataFrame, ring: int, size: int, batch_update: bool) -> DataFrame:
    """Whether a circular offset lies in the buffer's live range.

    The range is [begin, end) around the ring; batch update keeps one active part before it.
    """
    begin = F.col("begin") - (size if batch_update else 0)
    span = F.pmod(F.col("end") - begin, F.lit(ring))
    return rows.withColumn("is_valid", F.pmod(F.col("offset") - begin, F.lit(ring)) < F.when(span == 0, ring).otherwise(span))
