"""Shared pieces of the corpus operators: scratch tables, words, shingle hashes.

Everything here is size-independent: caches are bounded, arrays are built for
one Arrow batch at a time, and scratch tables go to the shared folder that the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where a local session names no checkpoint folder (unit tests).
LOCAL_SCRATCH = "/tmp/checkpoints/textrine"

#: Distinct words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 150_000

GOLD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Python tasks that are run inside get at most ``rows`` rows at once: a batch of texts is held by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(given)) if int(given) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def partitions_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Written tables that cut a lineage: ``keep`` writes and rereads, ``drop`` removes.

    A lost executor costs only the stage that was running, since finished
    tables are on shared storage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = LOCAL_SCRATCH
        self.root = f"{base.rstrip('/')}/textrine-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.kept: set[str] = set()

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self.drop_paths({df._scratch_path for df in tables} & self.kept)

    def drop_paths(self, paths: set[str]) -> None:
        for x in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.kept -= paths

    def drop_all(self, *but: DataFrame) -> None:
        """What is still there goes, but for the tables that the result reads."""
        self.drop_paths(self.kept - {df._scratch_path for df in but})


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word (bytes) -> 64-bit number, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = h
        return h


def text_words(text: str | None, fold: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; null has none.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is exactly the
    six separators and the A-Z folding that the contracts name.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if fold else raw).split()


def batch_shingles(texts, cache: WordHashes, n: int = 5):
    """Shingle hashes of a batch of texts.

    Returns (hashes, offsets): text i owns ``hashes[offsets[i]:offsets[i+1]]``,
    in text order with repeats. A text with 1..n-1 words has one shingle, its
    whole sequence; a text without words has none.
    """
    lists = [text_words(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    look = cache.__getitem__
    flat = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for words in lists:
        flat[at : at + len(words)] = list(map(look, words))
        at += len(words)
    return shingle_hashes(flat, counts, n)


def shingle_hashes(flat: np.ndarray, counts: np.ndarray, n: int):
    """Hashes of the n-word windows of each run of ``counts`` word hashes."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    base = np.uint64(0xD6E8FEB86659FD93)
    total = len(flat)
    acc = np.zeros(total, np.uint64)
    for j in range(n):  # windows that run over the end of a text are dropped below
        acc *= base
        if j < total:
            acc[: total - j] += flat[j:]
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(have)])
    index = np.arange(offsets[-1]) + np.repeat(starts[:-1] - offsets[:-1], have)
    out = acc[index]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in flat[starts[i] : starts[i + 1]]:
                h = h * base + w
            out[offsets[i]] = h + np.uint64(int(counts[i]) * GOLD & (2**64 - 1))
    return mix64(out), offsets


def distinct_per_text(hashes: np.ndarray, offsets: np.ndarray):
    """Sorted distinct hashes of each text, as (values, offsets)."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[fresh], o[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n))])


def slices(sizes, most: int):
    """(from, to) ranges of rows whose sizes sum to about ``most`` at the most.

    A single row above the bound makes a range of its own.
    """
    lo = held = 0
    for i, s in enumerate(sizes):
        if i > lo and held + s > most:
            yield lo, i
            lo, held = i, 0
        held += s
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(column, most: int):
    """(from, to, texts) of an Arrow string column, about ``most`` bytes at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield a, b, column[a:b].to_pylist()
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """What this worker has freed goes back to the system, which allocators put off while a worker waits for its next batch or task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: A set of hashed numbers as one bit each: 16 MB, whatever the set's size.
BITMAP_BITS = 27


def bitmap_of(df: DataFrame, column: str):
    """Broadcast bitmap of the top bits of a column of longs.

    Its size is fixed; what passes ``in_bitmap`` by chance must be harmless or
    dropped by a later join.
    """
    bit = F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS)
    rows = df.select((bit / 32768).cast("long").alias("b"), (bit % 32768).alias("i")).groupBy("b").agg(F.bitmap_construct_agg("i").alias("bits"))
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in rows.toLocalIterator():
        bits[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    i = numbers.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return ((bits[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
