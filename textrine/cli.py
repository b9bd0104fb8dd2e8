"""Command line: build the tree of text files, or slide a window over them.

    python -m textrine.cli tree -t SL -a M -b T [-B] [-s] [-d OUT] [-e ENCODING] [-p N] [-r C|D] [-c N] PATH
    python -m textrine.cli window -t SH -a U -b T [-k BLOCK] [-A ACTIVE] [-S TOTAL] [-m B|F] [-v] [-d OUT] PATH

Benchmark C reports statistics, T also the traversal log (to -d as text files,
else to standard output).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textrine.functions.numeric import human_size
from textrine.operators import memory, traverse, trees, windows
from textrine.options import Options
from textrine.queries import build
from textrine.sources import blocks, text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="textrine", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = out.add_subparsers(dest="kind", required=True)
    for kind in ("tree", "window"):
        p = kinds.add_parser(kind)
        p.add_argument("path")
        p.add_argument("-t", dest="layout", required=True, choices=("SL", "SH", "LA"))
        p.add_argument("-a", dest="algorithm", required=True, choices=tuple("AMBUP"))
        p.add_argument("-B", dest="backward", action="store_true", help="the variation with parent pointers")
        p.add_argument("-b", dest="benchmark", required=True, choices=("C", "T"))
        p.add_argument("-s", dest="simple", action="store_true")
        p.add_argument("-d", dest="dump")
        p.add_argument("-e", dest="encoding", default="UTF-8")
        p.add_argument("-r", dest="collision", choices=("C", "D"))
        p.add_argument("-c", dest="hash_functions", type=int)
        if kind == "tree":
            p.add_argument("-p", dest="prefix_length", type=int)
        else:
            p.add_argument("-k", dest="block", type=int)
            p.add_argument("-A", dest="active", type=int)
            p.add_argument("-S", dest="total", type=int)
            p.add_argument("-m", dest="method", default="B", choices=("B", "F", "L"))
            p.add_argument("-v", dest="statistics", action="store_true")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run a command; returns the DataFrames that it showed or wrote, by name."""
    a = parser().parse_args(arguments)
    names = ("layout", "algorithm", "backward", "benchmark", "simple", "dump", "collision", "hash_functions")
    chosen = Options(**{k: getattr(a, k) for k in names}, prefix_length=getattr(a, "prefix_length", None), window=a.kind == "window").checked()
    spark = spark or SparkSession.builder.appName("textrine").getOrCreate()
    texts = text.read_texts(spark, a.path, a.encoding)
    out = {}
    if a.kind == "tree":
        out["stats"] = memory.tree_stats(trees.tree_counts(texts), chosen.record).withColumn("used", human_size(F.col("used_bytes")))
        if a.benchmark == "T":
            out["log"] = traverse.log(build(texts, chosen), chosen.detailed)
            if a.dump:
                traverse.write_log(build(texts, chosen), a.dump, chosen.detailed)
    else:
        spec = blocks.WindowSpec(a.block, a.active, a.total, a.method).resolved()
        out["snapshots"] = windows.snapshots(texts, spec.block, spec.active).drop("buffer")
        if a.statistics:
            out["stats"] = windows.window_stats(texts, spec.window)
        if a.benchmark == "T":
            out["log"] = windows.window_edges(windows.snapshots(texts, spec.block, spec.active)).orderBy("doc_id", "window_no", "path")
            if a.dump:
                out["log"].write.mode("overwrite").partitionBy("doc_id").parquet(a.dump)
    return out


if __name__ == "__main__":
    for name, df in main().items():
        print(f"{name}:")
        for row in df.toLocalIterator():
            print(row["line"] if name == "log" and "line" in df.columns else row.asDict())
