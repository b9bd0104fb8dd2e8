"""Memory models of the tree layouts, and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Bytes of a leaf, an edge record and a branching node in each layout.
RECORDS = {"SL": (4, 0, 20), "SH": (0, 8, 12), "SL_BP": (8, 0, 24), "SH_BP": (4, 8, 16), "LA": (0, 0, 0)}
CELL = 4
WINDOW_RECORDS = {"SL": (8, 0, 24), "SH": (4, 8, 20)}


def tree_stats(counts: DataFrame, layout: str) -> DataFrame:
    """Used bytes, and per character, of each text's tree in a layout.

    ``la_cells`` counts one cell per leaf and two per branching node but the
    root; ``la_records`` is the reported value, one less.
    """
    leaf, edge, branch = RECORDS[layout]
    cells = F.col("n") + 1 + 2 * (F.col("branching_nodes") - 1)
    used = (F.col("n") + 1) * leaf + F.col("edges") * edge + F.col("branching_nodes") * branch + (cells * CELL if layout == "LA" else F.lit(0))
    out = counts.select("doc_id", F.lit(layout).alias("layout"), F.col("n").alias("length"), "edges", "branching_nodes", cells.alias("la_cells"), (cells - 1).alias("la_records"), used.cast("long").alias("used_bytes"))
    return out.withColumn("bytes_per_char", F.when(F.col("length") > 0, F.col("used_bytes") / F.col("length")))


def grown(nodes: Column, n: Column) -> Column:
    """Records that the node table of a text of n characters has room for, once it holds ``nodes``.

    It starts with the greatest power of two up to n. When it is full, it grows before the next suffix: by
    half of that first, then by half the step before, 128 at least, up to n records.
    """
    first = F.when(n > 0, F.pow(F.lit(2), F.length(F.bin(n)) - 1)).otherwise(0).cast("long")
    start = F.struct(first.alias("size"), F.floor(first / 2).cast("long").alias("step"))

    def grow(at, _):
        larger = F.struct(F.least(at["size"] + at["step"], n).alias("size"), F.when(at["step"] < 256, 128).otherwise(F.floor(at["step"] / 2)).cast("long").alias("step"))
        return F.when((at["size"] <= nodes) & (at["size"] < n), larger).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, grow, lambda at: at["size"])


def allocation(counts: DataFrame, layout: str) -> DataFrame:
    """Allocated bytes and load factors of each text's tree, for the layouts without a hash table (SL, SL_BP)."""
    leaf, edge, branch = RECORDS[layout]
    if edge or not branch:
        raise NotImplementedError(f"no allocation model for {layout}")
    rows = tree_stats(counts, layout).withColumn("node_records", grown(F.col("branching_nodes"), F.col("length")))
    rows = rows.withColumn("allocated_bytes", (F.col("length") + 2) * leaf + (F.col("node_records") + 1) * branch)
    return rows.select(
        "doc_id", "layout", "node_records", "allocated_bytes", "used_bytes",
        F.when(F.col("length") > 0, F.col("allocated_bytes") / F.col("length")).alias("allocated_per_char"),
        F.when(F.col("node_records") > 0, F.lit(100.0) * F.col("branching_nodes") / F.col("node_records")).alias("node_load_percent"),
        (F.lit(100.0) * F.col("used_bytes") / F.col("allocated_bytes")).alias("memory_load_percent"),
    )


def window_memory(stats: DataFrame, layout: str, window: int) -> DataFrame:
    """Used bytes of the window tree from the per-slide averages."""
    leaf, edge, branch = WINDOW_RECORDS[layout]
    used = F.least(F.col("n"), F.lit(window)) * leaf + F.floor(F.col("avg_edges") + 0.5) * edge + F.floor(F.col("avg_bn") + 0.5) * branch
    return stats.select("doc_id", F.lit(layout).alias("layout"), used.cast("long").alias("used_bytes"), (used / window).alias("bytes_per_window_char"))


def high_water(changes: DataFrame, by: str, order: str, delta: str) -> DataFrame:
    """Running total of allocations and its maximum so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = changes.withColumn("in_use", F.sum(delta).over(w))
    return total.withColumn("high_water", F.max("in_use").over(w))
