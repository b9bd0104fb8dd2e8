"""Navigation on edges: children by letter, siblings, scans, loci.

All of it is joins and windows on ``edges`` keyed by document and node, which
Catalyst plans on one exchange per key. Edges have a row for each character, but
Spark estimates what a Python task returns by the bytes of the texts: without the
``merge`` hint it would broadcast them through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textrine.operators.trees import per_batch
from textrine.plans.kernel import SuffixTrees

#: SQL: the edge is the terminator alone. A text may have the letter "$" too, so that labels cannot tell.
IS_END = "(child < 0 AND child_depth = parent_depth + 1)"


def child_by_letter(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """The child of each (doc_id, parent, letter) probe, or none; the terminator is no letter."""
    found = edges.where(f"NOT {IS_END}").select("doc_id", "parent", "letter", "child", "child_depth")
    return probes.join(found.hint("merge"), ["doc_id", "parent", "letter"], "left")


def siblings(edges: DataFrame) -> DataFrame:
    """Each child with the ones before and after it among its parent's, by letter."""
    w = Window.partitionBy("doc_id", "parent").orderBy("ord")
    return edges.select("doc_id", "parent", "child", "letter", F.lag("child").over(w).alias("prev_child"), F.lead("child").over(w).alias("next_child"))


def first_children(edges: DataFrame) -> DataFrame:
    return edges.groupBy("doc_id", "parent").agg(F.min_by("child", "ord").alias("first_child"), F.count("*").alias("n_children"))


def parents(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", F.col("child").alias("node_id"), "parent")


def node_groups(edges: DataFrame) -> DataFrame:
    """Child groups as a partitioning build writes them: leaf or branching, last of its parent."""
    w = Window.partitionBy("doc_id", "parent").orderBy("ord")
    return edges.select("doc_id", "parent", F.row_number().over(w).alias("nth"), "letter", (F.col("child") < 0).alias("is_leaf"), F.lead("child").over(w).isNull().alias("is_last"))


def children_lcp(edges: DataFrame) -> DataFrame:
    """Least label length among each parent's branching children (null without any)."""
    return edges.groupBy("doc_id", "parent").agg(F.min(F.when(F.col("child") > 0, F.col("label_len"))).alias("children_lcp"))


def common_length(a: str, b: str) -> str:
    """SQL: length of the longest common prefix of two short strings."""
    return f"""aggregate(sequence(1, greatest(1, least(length({a}), length({b})))), 0,
        (n, k) -> if(n = k - 1 AND k <= least(length({a}), length({b})) AND substr({a}, k, 1) = substr({b}, k, 1), k, n))"""


def scans(edges: DataFrame, patterns: list[str], parent: int = 1) -> DataFrame:
    """Fastscan, slowscan and depthscan of patterns at a node's edges.

    fast: 0 if an edge starts with the pattern's first letter, else 2. slow:
    matched characters, and 0 if the label ends first or with the pattern, 2 if
    the pattern ends inside the label, -1 or 1 by the sign of the mismatch.
    depth: sign of the child's depth minus the pattern's length.
    """
    probes = edges.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    docs = edges.where(F.col("ord") == 1).select("doc_id")
    asked = docs.join(F.broadcast(probes))  # a handful of given patterns per document
    here = edges.where((F.col("parent") == parent) & ~F.expr(IS_END)).select("doc_id", "letter", "child", "child_depth", F.expr("substr(label, 1, label_len - IF(child < 0, 1, 0))").alias("label"))
    met = asked.withColumn("letter", F.substring("pattern", 1, 1)).join(here.hint("merge"), ["doc_id", "letter"], "left")
    n = F.expr(f"CASE WHEN child IS NULL THEN 0 ELSE {common_length('label', 'pattern')} END")
    out = met.withColumn("matched", n)
    mismatch = F.when(F.substring(F.col("label"), F.col("matched") + 1, F.lit(1)) > F.substring(F.col("pattern"), F.col("matched") + 1, F.lit(1)), 1).otherwise(-1)
    ended = F.col("matched") == F.length("label")  # of the letters; a leaf's edge goes on with the terminator
    slow = (
        F.when(F.col("child").isNull(), None)
        .when(ended & (F.col("child") > 0), 0)
        .when(F.col("matched") == F.length("pattern"), 2)
        .when(ended, 1)
        .otherwise(mismatch)
    )
    return out.select(
        "doc_id", "pattern", F.coalesce("child", F.lit(0)).alias("child"),
        F.when(F.col("child").isNull(), 2).otherwise(0).alias("fast"), F.col("matched").alias("matched"), slow.alias("slow"),
        F.signum(F.col("child_depth") - F.length("pattern")).cast("int").alias("depth"),
    )


def fastscans(edges: DataFrame, patterns: list[str], parent: int = 1) -> DataFrame:
    """Every edge of a node against each pattern's first letter: -1 if the edge's letter is smaller, 0 if equal, 1 if larger; the end is the largest."""
    probes = edges.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    asked = edges.where(F.col("parent") == parent).join(F.broadcast(probes))  # a handful of given patterns
    wanted, end = F.substring("pattern", 1, 1), F.expr(IS_END)
    sign = F.when(end, 1).when(F.col("letter") < wanted, -1).when(F.col("letter") == wanted, 0).otherwise(1)
    return asked.select("doc_id", "pattern", "child", sign.alias("fast"))


def locus(edges: DataFrame, depth: int) -> DataFrame:
    """For each suffix longer than ``depth``: the deepest node at or above that depth.

    ``exact`` is 0 if a node has that depth, -1 if an edge runs across it.
    """
    across = edges.where((F.col("parent_depth") <= depth) & (F.col("child_depth") > depth))
    # a leaf lies below the edge that its path takes at this depth: same letters, so the same string prefix
    return across.select("doc_id", F.col("parent").alias("node"), F.col("parent_depth").alias("node_depth"), "child", F.when(F.col("parent_depth") == depth, 0).otherwise(-1).alias("exact"))


def go_up(edges: DataFrame, depth: int) -> DataFrame:
    """For each node but the root: the edge (parent, child) that a climb from it to ``depth`` ends on.

    ``child`` is the last node of the climb (the node itself if its parent is not deeper),
    ``exact`` 0 if the parent has that depth, -1 if it is shallower. In traversal order an
    edge comes before all below it, so this is the last one so far whose parent is not deeper.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(F.col("parent_depth") <= depth, F.struct("parent", "child", "parent_depth")), ignorenulls=True).over(w)
    found = edges.select("doc_id", F.col("child").alias("node"), met.alias("met"))
    return found.select("doc_id", "node", "met.parent", "met.child", F.when(F.col("met.parent_depth") == depth, 0).otherwise(-1).alias("exact"))


def go_up_texts(texts: DataFrame, depth: int) -> DataFrame:
    """``go_up`` of the edges of ``texts``, climbed where the edges are made.

    The task that makes a text's edges has them in traversal order, so that nothing is
    shuffled or sorted again, and only what is shown of the climb leaves the task.
    """
    if depth < 0:
        raise ValueError("depths are not negative")

    def make(rows):
        e = SuffixTrees(rows).edges()
        # a text's first edge leaves its root, so that the last edge so far is of the same text
        met = np.maximum.accumulate(np.where(e["parent_depth"] <= depth, np.arange(len(e["doc"])), 0))
        return {"doc": e["doc"], "node": e["child"], "parent": e["parent"][met], "child": e["child"][met], "exact": np.where(e["parent_depth"][met] == depth, 0, -1)}

    return per_batch(texts, make, "doc_id long, node int, parent int, child int, exact int")


def jump_pointers(edges: DataFrame, keep=None) -> list[DataFrame]:
    """For k = 0, 1, ...: doc_id, node, up, up_depth, the ancestor 2^k above each node that has one.

    Each is a join of the one before with itself, so that a chain of any length has
    the logarithm of its length as the number of joins; ``keep`` writes a step's table.
    """
    keep = keep or (lambda df, name: df)
    steps = [keep(edges.select("doc_id", F.col("child").alias("node"), F.col("parent").alias("up"), F.col("parent_depth").alias("up_depth")), "up0")]
    while True:
        further = steps[-1].select("doc_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("up_depth").alias("_depth"))
        step = keep(steps[-1].drop("up_depth").join(further.hint("merge"), ["doc_id", "up"]).select("doc_id", "node", F.col("_up").alias("up"), F.col("_depth").alias("up_depth")), f"up{len(steps)}")
        if step.isEmpty():
            return steps
        steps.append(step)


def go_up_each(edges: DataFrame, asks: DataFrame, keep=None) -> DataFrame:
    """``asks`` (doc_id, node, depth, and any other columns), each with the edge (parent, child) that a climb from its node to its own depth ends on.

    As ``go_up``: ``child`` is the last node of the climb, ``exact`` 0 if the parent has that
    depth, -1 if it is shallower. Asks of nodes that are not there have no row.
    """
    found = asks.withColumn("child", F.col("node"))
    for step in reversed(jump_pointers(edges, keep)):
        there = step.select("doc_id", F.col("node").alias("child"), "up", "up_depth")
        found = found.join(there.hint("merge"), ["doc_id", "child"], "left").withColumn("child", F.when(F.col("up_depth") > F.col("depth"), F.col("up")).otherwise(F.col("child"))).drop("up", "up_depth")
    last = edges.select("doc_id", "child", "parent", F.col("parent_depth").alias("_depth"))
    return found.join(last.hint("merge"), ["doc_id", "child"]).withColumn("exact", F.when(F.col("_depth") == F.col("depth"), 0).otherwise(-1)).drop("_depth")


def place_links(edges: DataFrame, asks: DataFrame, keep=None) -> DataFrame:
    """The suffix links of places inside edges: asks (doc_id, node, at) name the place of depth ``at`` on the edge to ``node``.

    Found is the edge (parent, child) on which the string without its first letter ends,
    ``exact`` 0 if it ends on the parent itself, -1 if inside the edge.
    """
    target = edges.select("doc_id", F.col("child").alias("node"), F.when(F.col("child") < 0, F.col("child") - 1).otherwise(F.col("suffix_link")).alias("_link"))
    linked = asks.join(target.hint("merge"), ["doc_id", "node"]).select("doc_id", F.col("node").alias("_node"), "at", F.col("_link").alias("node"), (F.col("at") - 1).alias("depth"))
    return go_up_each(edges, linked, keep).select("doc_id", F.col("_node").alias("node"), "at", "parent", "child", "exact")


def upsert(records: DataFrame, changes: DataFrame, key: list[str], value: str, vacant=None) -> DataFrame:
    """Records keyed by ``key`` after changes: inserted, overwritten, or removed where the new value is ``vacant``.

    What a hash table of edges does one record at a time; here one join on the key.
    """
    fresh = changes.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_changed"))
    out = records.select(*key, value).join(fresh, key, "full").withColumn(value, F.when(F.col("_changed"), F.col("_new")).otherwise(F.col(value)))
    out = out.drop("_new", "_changed")
    return out if vacant is None else out.where(F.col(value) != vacant)
