"""Rendering: edges, suffixes and framed logs as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: From this label length on only the ends are shown, this many characters each.
LONG, SHOWN = 33, 15


def padded(number: Column, width: Column) -> Column:
    """%0*d: zeros after the sign."""
    digits = F.abs(number).cast("string")
    return F.when(number < 0, F.concat(F.lit("-"), F.lpad(digits, F.greatest(width - 1, F.length(digits)), F.lit("0")))).otherwise(F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0")))


def shortened(label: Column) -> Column:
    return F.when(F.length(label) < LONG, label).otherwise(F.concat(F.left(label, F.lit(SHOWN)), F.lit("..."), F.right(label, F.lit(SHOWN))))


def widths(edges: DataFrame) -> DataFrame:
    """Digits of the number of nodes and of suffixes of each text."""
    per = edges.groupBy("doc_id").agg(F.max("child").alias("top"), F.min("child").alias("low"))
    return per.select("doc_id", F.length(F.greatest("top", F.lit(1)).cast("string")).alias("wb"), F.length((-F.col("low")).cast("string")).alias("wl"))


def edge_lines(edges: DataFrame, detailed: bool) -> DataFrame:
    """doc_id, ord, line: P(id)[depth]--"label"(length)-->C(id)[depth]{link}.

    The simple form shows neither branching ids nor links.
    """
    w = edges.join(widths(edges).hint("merge"), "doc_id")  # as in ``navigate``
    parent = padded(F.col("parent"), F.col("wb")) if detailed else F.lit("?")
    leaf = padded(F.col("child"), F.col("wl"))
    child = F.when(F.col("child") < 0, leaf).otherwise(padded(F.col("child"), F.col("wb")) if detailed else F.lit("?"))
    link = F.when(F.col("suffix_link") != 0, F.concat(F.lit("{"), padded(F.col("suffix_link"), F.col("wb")), F.lit("}"))).otherwise("") if detailed else F.lit("")
    line = F.concat(
        F.lit("P("), parent, F.lit(")["), F.col("parent_depth").cast("string"), F.lit(']--"'), shortened(F.col("label")), F.lit('"('),
        F.col("label_len").cast("string"), F.lit(")-->C("), child, F.lit(")["), F.col("child_depth").cast("string"), F.lit("]"), link,
    )
    return w.select("doc_id", F.col("ord").cast("long").alias("ord"), line.alias("line"))


def log(edges: DataFrame, detailed: bool) -> DataFrame:
    """The framed traversal log of each text: doc_id, ord, line."""
    title = "Suffix tree traversal" if detailed else "Simple suffix tree traversal"
    frame = edges.groupBy("doc_id").agg(F.max("ord").alias("last"))
    begin = frame.select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit(f"{title} BEGIN").alias("line"))
    end = frame.select("doc_id", (F.col("last") + 1).cast("long").alias("ord"), F.lit(f"{title} END").alias("line"))
    return begin.union(edge_lines(edges, detailed)).union(end)


def suffix_lines(texts: DataFrame) -> DataFrame:
    """doc_id, i, line: "i: suffix$ (length)", long suffixes by their ends."""
    n = F.length("text")
    rows = texts.select("doc_id", F.concat("text", F.lit("$")).alias("s"), n.alias("n"), F.explode(F.sequence(F.lit(1), n + 1)).alias("i"))
    size = F.col("n") + 2 - F.col("i")
    shown = F.when(size < LONG, F.substring("s", F.col("i"), size)).otherwise(F.concat(F.substring("s", F.col("i"), F.lit(SHOWN)), F.lit("..."), F.right("s", F.lit(SHOWN))))
    return rows.select("doc_id", "i", F.concat(F.col("i").cast("string"), F.lit(": "), shown, F.lit(" ("), size.cast("string"), F.lit(")")).alias("line"))


def write_log(edges: DataFrame, path: str, detailed: bool) -> None:
    """The log as text files with lines "doc_id<tab>line", in order of document and line from file to file.

    Range partitions: a file holds many documents, and a large one spans several files.
    """
    lines = log(edges, detailed).repartitionByRange("doc_id", "ord").sortWithinPartitions("doc_id", "ord")
    lines.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)


def linear_array(edges: DataFrame) -> DataFrame:
    """Cells of the packed array layout: nodes with their child groups in traversal order.

    A leaf takes one cell, a branching node two (label start and first child);
    ``is_last`` marks the last child of its parent.
    """
    w = Window.partitionBy("doc_id", "parent").orderBy("ord")
    return edges.select("doc_id", "ord", "parent", F.when(F.col("child") < 0, 1).otherwise(2).alias("cells"), (F.col("start") + F.col("parent_depth")).alias("text_index"), F.lead("child").over(w).isNull().alias("is_last"))
