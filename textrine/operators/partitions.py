"""Prefix partitions of suffixes, as a partition-and-write build makes them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textrine.operators.trees import per_batch
from textrine.plans.kernel import SuffixArrays, code_points


def auto_prefix_length(n: Column) -> Column:
    """Prefix length for a text of n characters: 0 up to 2^20 suffixes, then by size."""
    size = n.cast("long") + 1
    steps = F.lit(1)
    for k in range(12):
        steps = steps + F.when(F.shiftright(size, 25 + 5 * k) > 0, 1).otherwise(0)
        if 25 + 5 * (k + 1) >= 63:
            break
    return F.when(size <= (1 << 20), 0).otherwise(steps).cast("int")


def chosen_prefix_length(n: Column, wanted: Column) -> Column:
    """A given length (if not negative) or the automatic one, n + 1 at most."""
    return F.least(F.when(wanted >= 0, wanted).otherwise(auto_prefix_length(n)), n + 1)


def partitions(texts: DataFrame, prefix: int) -> DataFrame:
    """Groups of suffixes with equal first characters: offsets, common length, least start.

    Groups are the runs of a suffix array whose common prefixes are not shorter than
    ``prefix``. A single suffix has its whole length, terminator included.
    """

    def make(rows):
        sa = SuffixArrays(rows)
        at = np.flatnonzero(sa.lcp < prefix)
        doc, size = sa.doc[at], np.diff(np.append(at, len(sa.lcp)))
        begin = at - sa.bounds[doc] + 1
        inside = sa.lcp.copy()
        inside[at] = len(sa.lcp)
        whole = (sa.end - sa.order)[at]
        return {
            "doc": doc, "idx": np.arange(len(at)) - np.searchsorted(doc, doc), "begin_offset": begin, "end_offset": begin + size,
            "lcp_size": np.where(size == 1, whole, np.minimum.reduceat(inside, at)), "text_offset": np.minimum.reduceat(sa.start, at),
        }

    return per_batch(texts, make, "doc_id long, idx int, begin_offset long, end_offset long, lcp_size int, text_offset int")


def select_partition(texts: DataFrame, prefix: str) -> DataFrame:
    """doc_id, i: the suffixes of one partition, those that start with ``prefix``."""
    wanted = [ord(c) for c in prefix]

    def make(rows):
        chars, bounds = code_points(rows)
        hit = np.ones(len(chars), bool)
        for k, c in enumerate(wanted):  # a terminator is no character, so that no match crosses texts
            hit[: len(chars) - k] &= chars[k:] == c
            hit[len(chars) - k :] = False
        at = np.flatnonzero(hit)
        doc = np.searchsorted(bounds, at, "right") - 1
        return {"doc": doc, "i": at - bounds[doc] + 1}

    return per_batch(texts, make, "doc_id long, i int")


def distributed_suffix_array(spark, text: str | None = None, chars: DataFrame | None = None) -> DataFrame:
    """i, rank of one text of any size, sorted across the cluster by prefix doubling.

    ``chars`` has (i, c): positions from 1 and characters. Each round joins a
    rank with the one 2^k further (equi-join on position), sorts by range and
    numbers the groups by partition offsets, so that no partition holds the text.
    Rounds end when all ranks differ, at most log2 of the longest repeat + 1.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    if chars is None:
        chars = spark.createDataFrame([(i + 1, ord(c)) for i, c in enumerate(text or "")], "i long, c long")
    n = chars.count()
    ranks = chars.select("i", F.col("c").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.createDataFrame([(n + 1, 0x110000, 0)], StructType([StructField(x, LongType()) for x in "iab"])))
    step = 1
    while True:
        ranks = rank_by_range(ranks).checkpoint()
        if ranks.select("rank").distinct().count() == n + 1:
            return ranks.select("i", "rank")
        ahead = ranks.select((F.col("i") - step).alias("i"), F.col("rank").alias("b"))
        ranks = ranks.select("i", F.col("rank").alias("a")).join(ahead, "i", "left").select("i", "a", F.coalesce("b", F.lit(0)).alias("b"))
        step *= 2


def rank_by_range(pairs: DataFrame) -> DataFrame:
    """i, rank: how many pairs are at most (a, b), by range partitions and their counts.

    Equal pairs lie in one range partition, so a window inside the partition and
    the sizes of the partitions before it are enough.
    """
    groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    dealt = groups.repartitionByRange("a", "b").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("size"))
    offsets = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy("x.part").agg(F.coalesce(F.sum("y.size"), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(F.broadcast(offsets), "part").select("a", "b", (F.sum("n").over(w) + F.col("before")).alias("rank"))
    return pairs.join(ranked, ["a", "b"]).select("i", "rank")
