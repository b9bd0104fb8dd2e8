"""Sorted relations that no task holds: numbering, and searches over ranges of them.

``ordered`` sorts by range and numbers rows across tasks; ties are dealt over
several tasks, since a further column breaks them, and runs of equal values go on
from one task to the next. ``Blocks`` keeps a numbered relation as slices of SPAN
places, one row each; searches ask one slice, and if the answer lies further the
slice that the minima of all slices name. What the driver holds is a few numbers
for each task or slice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from textrine.sources.scratch import Scratch


def _fresh(columns: list[np.ndarray], before: list | None) -> np.ndarray:
    """Which rows differ from the one before them, the first from ``before``."""
    out = np.zeros(len(columns[0]), bool)
    for k, c in enumerate(columns):
        out[1:] |= c[1:] != c[:-1]
        out[0] |= before is None or c[0] != before[k]
    return out


def ordered(df: DataFrame, by: list[str], levels: list[list[str]], parts: int, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with its place in the order of ``by``: pos (from 0), and for each level run0, run1, ...

    A run is the place of the first row with the same values in the level's
    columns, which are longs and lead ``by``. ``tied``: another row has the same
    values in the last level's. ``by`` has to tell all rows apart.
    """
    import pyarrow as pa

    runs = [f"_run{k}" for k in range(len(levels))]
    added = [StructField("_part", IntegerType()), StructField("_at", LongType()), *(StructField(r, LongType()) for r in runs), StructField("_fresh", BooleanType()), StructField("_next", BooleanType())]

    def number(batches):
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, None
        last, begun = [None] * len(levels), [0] * len(levels)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            place, out = at + np.arange(n), []
            for k, level in enumerate(levels):
                columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in level]
                fresh = _fresh(columns, last[k])
                out.append(np.maximum.accumulate(np.where(fresh, place, begun[k])))
                last[k], begun[k] = [c[-1] for c in columns], int(out[k][-1])
            if held is not None:
                yield closed(*held, bool(fresh[0]))
            held, at = (part, batch, place, out, fresh), at + n
        if held is not None:
            yield closed(*held, None)

    def closed(part, batch, place, out, fresh, after):
        follows = pa.array([*fresh[1:].tolist(), after], pa.bool_())
        more = [pa.array(np.full(len(batch), part, np.int32)), pa.array(place), *map(pa.array, out), pa.array(fresh), follows]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f.name for f in added)])

    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = scratch.keep(dealt.mapInArrow(number, StructType(df.schema.fields + added)), name)
    keys = list(dict.fromkeys(c for level in levels for c in level))
    ends = placed.groupBy("_part").agg((F.max("_at") + 1).alias("n"), F.min_by(F.struct(*keys), "_at").alias("first"), F.max_by(F.struct(*keys, *runs), "_at").alias("last"))
    bounds, offset, before, begun = [], 0, None, []
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row for each task
        goes_on = [before is not None and all(before[c] == row["first"][c] for c in level) for level in levels]
        carried = [begun[k] if goes_on[k] else offset for k in range(len(levels))]
        bounds.append([row["_part"], offset, *carried, not goes_on[-1], True])
        if len(bounds) > 1:
            bounds[-2][-1] = not goes_on[-1]
        begun = [carried[k] if row["last"][r] == 0 else offset + row["last"][r] for k, r in enumerate(runs)]
        before, offset = row["last"], offset + row["n"]
    schema = "_part int, _offset long, " + "".join(f"_carried{k} long, " for k in range(len(levels))) + "_starts boolean, _ends boolean"
    told = placed.join(F.broadcast(df.sparkSession.createDataFrame(bounds, schema)), "_part")
    starts = F.when(F.col("_at") == 0, F.col("_starts")).otherwise(F.col("_fresh"))
    run = [F.when(F.col(r) == 0, F.col(f"_carried{k}")).otherwise(F.col("_offset") + F.col(r)).alias(f"run{k}") for k, r in enumerate(runs)]
    return told.select(*df.columns, (F.col("_offset") + F.col("_at")).alias("pos"), *run, (~(starts & F.coalesce("_next", "_ends"))).alias("tied"))


class Minima:
    """Minima of all runs of 2^k entries, for searches of many places at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values)]
        while (1 << len(self.levels)) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def before(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """For each ``at`` the last place up to it with a value under ``below``, or -1."""
        at = np.array(at)
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            level = self.levels[k]
            skip = (start >= 0) & (level[np.clip(start, 0, len(level) - 1)] >= below)
            at = np.where(skip, start - 1, at)
        return at

    def minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value of each lo..hi, both included."""
        out = np.empty(len(lo), self.levels[0].dtype)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k) + 1])
        return out


class Both:
    """``before`` and ``after`` on one array."""

    def __init__(self, values: np.ndarray):
        self.n, self.forth, self.back = len(values), Minima(values), Minima(np.asarray(values)[::-1])

    def before(self, at, below):
        return self.forth.before(at, below)

    def after(self, at, below):
        """For each ``at`` the first place from it on with a value under ``below``, or the number of entries."""
        return self.n - 1 - self.back.before(self.n - 1 - np.asarray(at), below)


def unpacked(row, columns: list[str]) -> dict[str, np.ndarray]:
    """The arrays of one slice."""
    return {c: np.frombuffer(row[c], np.int64) for c in columns}


class Blocks:
    """Columns of longs of a relation with dense places ``pos``, in slices of ``span`` places."""

    def __init__(self, df: DataFrame, columns: list[str], span: int, parts: int, scratch: Scratch, name: str):
        import pyarrow as pa

        self.columns, self.span = columns, span

        def pack(batches):
            held: dict[str, list] = {c: [] for c in columns}
            rid = None

            def row():
                whole = {c: np.concatenate(x) for c, x in held.items()}
                return pa.RecordBatch.from_arrays([pa.array([rid]), *(pa.array([whole[c].tobytes()], pa.binary()) for c in columns), *(pa.array([int(f(whole[c]))]) for c in columns for f in (np.min, lambda x: x[0]))], names)

            for batch in batches:
                ids = batch.column("rid").to_numpy()
                cuts = np.flatnonzero(np.diff(ids)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                    if lo == hi:
                        continue
                    if rid is not None and ids[lo] != rid:
                        yield row()
                        held = {c: [] for c in columns}
                    rid = int(ids[lo])
                    for c in columns:
                        held[c].append(batch.column(c).to_numpy()[lo:hi].astype(np.int64))
            if rid is not None:
                yield row()

        names = ["rid", *columns, *(f"{k}_{c}" for c in columns for k in ("min", "first"))]
        schema = "rid long, " + ", ".join(f"{c} binary" for c in columns) + ", " + ", ".join(f"{k}_{c} long" for c in columns for k in ("min", "first"))
        sliced = df.select(F.expr(f"pos div {span}L").alias("rid"), "pos", *columns)
        self.rows = scratch.keep(sliced.repartition(parts, "rid").sortWithinPartitions("rid", "pos").mapInArrow(pack, schema), name)
        told = self.rows.drop(*columns).orderBy("rid").toPandas()  # two numbers a column for each slice
        self.least = {c: told[f"min_{c}"].to_numpy() for c in columns}
        self.first = {c: told[f"first_{c}"].to_numpy() for c in columns}

    def asked(self, queries: DataFrame, args: list[str], answer: Callable, schema: str) -> DataFrame:
        """``queries`` (rid and ``args``) with the columns of ``schema``: answer(slice, args) of each different query, made where the slice is."""
        columns = self.columns
        names = StructType.fromDDL(schema).names

        def solve(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(rows):
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in ["rid", *args, *names]})
            found = answer(unpacked(rows.iloc[0], columns), *(asks[a].to_numpy() for a in args))
            return asks.assign(**dict(zip(names, found)))

        different = queries.select("rid", *args).distinct()
        answers = different.groupBy("rid").cogroup(self.rows.select("rid", *columns).groupBy("rid")).applyInPandas(solve, "rid long, " + ", ".join(f"{a} long" for a in args) + ", " + schema)
        return queries.join(answers, ["rid", *args])

    def below_before(self, queries: DataFrame, column: str, pos: str, below: str, scratch: Scratch, name: str) -> DataFrame:
        """``queries`` with ``found``: the last place up to ``pos`` where ``column`` is under ``below``; there has to be one."""
        span, lows = self.span, Minima(self.least[column])
        rid = F.expr(f"{pos} div {span}L")

        def near(block, at, low):
            place = Minima(block[column]).before(at, low)
            return (place,)

        asked = self.asked(queries.withColumns({"rid": rid, "_at": F.col(pos) % span, "_low": F.col(below)}), ["_at", "_low"], near, "_place long")
        asked = scratch.keep(asked, f"{name}-near")

        @F.pandas_udf("long")
        def earlier(rids: pd.Series, low: pd.Series) -> pd.Series:
            return pd.Series(lows.before(rids.to_numpy() - 1, low.to_numpy()))

        def far(block, low):
            return (Minima(block[column]).before(np.full(len(low), len(block[column]) - 1), low),)

        here = asked.where("_place >= 0").withColumn("found", F.col("rid") * span + F.col("_place"))
        there = self.asked(asked.where("_place < 0").withColumn("rid", earlier("rid", "_low")), ["_low"], far, "_far long").withColumn("found", F.col("rid") * span + F.col("_far"))
        columns = [*queries.columns, "found"]
        return here.select(columns).union(there.select(columns))

