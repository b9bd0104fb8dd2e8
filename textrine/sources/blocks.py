"""Block-wise texts: the resolved sliding-window options, and blocks as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block, blocks of the active part, edge label maintenance.
BLOCK, ACTIVE = 8_388_608, 1
BATCH_UPDATE, CREDITS, LARSSON = 1, 2, 3
METHODS = {"B": BATCH_UPDATE, "F": CREDITS, "L": LARSSON}


@dataclass(frozen=True)
class WindowSpec:
    """Options of a sliding window over a text, as given; ``resolved`` fills them in.

    ``total`` blocks of ``block`` characters are buffered, of which ``active``
    carry the tree. Batch update needs twice the active part as a buffer.
    """

    block: int | None = None
    active: int | None = None
    total: int | None = None
    method: str | int = "B"

    def resolved(self) -> "WindowSpec":
        method = METHODS.get(self.method, self.method) if isinstance(self.method, str) else self.method
        if method not in METHODS.values():
            raise ValueError(f"edge label maintenance must be one of {sorted(METHODS)}")
        if method == LARSSON:
            raise NotImplementedError("edge label maintenance by Larsson's method")
        block, active = self.block or BLOCK, self.active or ACTIVE
        if block < 0 or active < 0 or (self.total or 0) < 0:
            raise ValueError("sizes are positive")
        least = 2 * active if method == BATCH_UPDATE else active + 1
        usual = 2 * active if method == BATCH_UPDATE else active + 2
        total = self.total or usual
        return WindowSpec(block, active, total if total >= least else least, method)

    @property
    def window(self) -> int:
        """Characters of the active part."""
        return self.block * self.active


def resolve(specs: DataFrame) -> DataFrame:
    """The same resolution for a relation of options (block, active, total, method)."""
    block = F.coalesce(F.nullif("block", F.lit(0)), F.lit(BLOCK)).cast("long")
    active = F.coalesce(F.nullif("active", F.lit(0)), F.lit(ACTIVE)).cast("long")
    batch = F.col("method") == "B"
    total = F.coalesce(F.nullif("total", F.lit(0)).cast("long"), F.when(batch, 2 * active).otherwise(active + 2))
    least = F.when(batch, 2 * active).otherwise(active + 1)
    return specs.where(F.col("method").isin("B", "F")).select(
        "spec_id", block.alias("block"), active.alias("active"), F.greatest(total, least).alias("total"), "method",
        (total < least).alias("adjusted"), (block * active).alias("max_active"), (block * F.greatest(total, least)).alias("max_total"),
    )


def cut(text: Column, size: int) -> Column:
    """A text's pieces of ``size`` characters (the last may be shorter), in one walk along it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def blocks(texts: DataFrame, block: int) -> DataFrame:
    """Each text cut into blocks: block_no from 0, chunk, whether it is partial."""
    rows = texts.where(F.length("text") > 0).select("doc_id", F.posexplode(cut(F.col("text"), block)).alias("block_no", "chunk"))
    return rows.withColumn("is_partial", F.length("chunk") < block)
