"""Suffix-array dedup with a logarithmic family of indexes.

Each byte covered by a LENGTH-byte string that also starts anywhere else (same
document included, overlaps count) is removed; strings never cross documents
and are judged on the input.

Entries. All suffixes of 30 GB would need many times its size, so the arrays are
sparse: of each LENGTH-byte window the GRAM-byte gram with the least hash (the
last of equal ones) is its anchor, and only suffixes at anchors are indexed.
Equal windows choose the same anchor at the same offset, so no match is lost.
The windows that chose an anchor span a stretch of the text around it, which has
a 128-bit digest; entries with equal spans and offsets form a class.

Arrays and family (``IndexFamily``). An array has one row for each distinct
prefix of GRAM bytes among its suffixes, with its number of entries, in the order
of the prefixes within each of a fixed number of buckets. Documents come in batches. A batch's array is scanned
together with each level's by a merge join, which needs no shuffle, as all
arrays share their buckets; a prefix in both, or twice in the batch, is a
candidate for a long match. Then levels of equal rank are merged, so that a row
is rewritten log(batches) times. A family lies in one folder and can be opened
again to add batches to it. Every batch is scanned against all that came before,
so a run over a corpus takes few of them: their number grows with the logarithm
of the input.

Extension. A second pass over the texts returns the entries whose prefix is a
candidate. All bytes of a class of two or more match. Where a prefix has several
classes and one of them a single entry, a third pass cuts out the span of one
entry of each class, and these are compared window by window, which extends each
match to the left and right to its ends.

Equality is by the digest (128 bits) or, window by window, by two 64-bit
polynomials with the prefix and the window's offset.

Hot groups: rows are counted by class before they are shuffled. Classes and
prefixes with more than their share of rows are few (at most PER_TASK for each
shuffle partition) and are broadcast instead of shuffled. Equal windows have
their anchor at the same place, so a prefix with more than WIDE classes is cut in
SLICES by that place, each compared by itself. A prefix with more than GROUP
classes is compared by a distributed count of window hashes instead of in the
memory of tasks.

Defined results: null and empty texts have 0 bytes; texts under LENGTH bytes
stay whole; rows with equal id and text are two documents that match each
other; rows with one id and different texts are told apart by a hash of the
text; ``text`` has the characters of which all bytes are kept; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrine.llm.common import Scratch, bitmap_of, in_bitmap, mix64, partitions_of, text_slices

LENGTH, GRAM = 400, 32
#: Input of which one batch is made at most; beyond it, each doubling makes one batch more.
BATCH_BYTES = 1 << 30
#: Bytes that are hashed at once; longer texts are taken in overlapping segments.
PART = 1 << 21
#: A class or prefix is hot if it has more than 1 / PER_TASK of the rows that a shuffle partition gets on average.
PER_TASK = 4
#: Classes of one prefix that tasks compare in memory.
GROUP = 20_000
#: Classes from which a prefix is cut in slices, and their number.
WIDE, SLICES = 2_000, 8

_rng = np.random.default_rng(400)
_TABLES = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 2 + 1
_LOW = np.uint64((1 << 24) - 1)


class Hasher:
    """Hashes of substrings of up to PART + LENGTH bytes by prefix sums modulo 2^64."""

    def __init__(self, size: int = PART + 2 * LENGTH):
        def powers(base: int) -> np.ndarray:
            out = np.full(size + 1, base % 2**64, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 2**64))

    def grow(self, size: int) -> None:
        if size > len(self.up) - 1:
            self.__init__(2 * size)

    def sums(self, buf: np.ndarray, which: int = 0) -> np.ndarray:
        """Prefix sums; ``which`` chooses one of two tables of byte values."""
        self.grow(len(buf))
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLES[which][buf] * self.up[: len(buf)], out=out[1:])
        return out

    def substrings(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return (sums[start + length] - sums[start]) * self.down[start]


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def parts(raws: list[bytes]):
    """Groups of (row, offset, bytes) of about PART bytes: whole texts, or overlapping segments of long ones."""
    group, held = [], 0
    for row, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, PART):
            piece = raw[at : at + PART + LENGTH - 1]
            if held and held + len(piece) > PART + LENGTH:
                yield group
                group, held = [], 0
            group.append((row, at, piece))
            held += len(piece)
    if group:
        yield group


def groups_of(column):
    """The same groups for an Arrow column, with the column's row numbers."""
    for a, _, texts in text_slices(column, 4 * PART):
        for group in parts([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
            yield [(a + row, at, piece) for row, at, piece in group]


def anchors(group):
    """Entries of a group as arrays: row, anchor, first and last window (in the text), the gram's hash, the buffer, and each first window's and anchor's place in it."""
    hs = hasher()
    sizes = np.array([len(x[2]) for x in group])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    buf = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
    sums = hs.sums(buf)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * hs.down[: len(buf) - GRAM + 1])
    low = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (_LOW - (low & _LOW)).astype(np.int64)
    piece = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[piece])
    anchor, piece = anchor[window], piece[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    p1, p2, at, of = window[first], window[last], anchor[first], piece[first]
    shift = np.array([x[1] for x in group])[of] - begins[of]
    return np.array([x[0] for x in group])[of], at + shift, p1 + shift, p2 + shift, grams[at], buf, p1, at


def digests(raw: bytes, begin: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Two signed longs for each span: 128 bits of its bytes and its anchor's offset."""
    import xxhash

    of, view = xxhash.xxh3_128_digest, memoryview(raw)
    joined = b"".join([of(view[b : b + s], o) for b, s, o in zip(begin.tolist(), size.tolist(), offset.tolist())])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"), "text")


def prefixes(docs: DataFrame) -> DataFrame:
    """gram and key (its hash) of every entry."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for group in groups_of(batch.column(0)):
                *_, key, buf, _, place = anchors(group)
                gram = np.lib.stride_tricks.sliding_window_view(buf, GRAM)[place] if len(place) else np.zeros((0, GRAM), np.uint8)
                grams = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GRAM), len(place), [None, pa.py_buffer(gram.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([grams, pa.array(key.view(np.int64))], ["gram", "key"])

    return docs.select("text").mapInArrow(run, "gram binary, key long")


class IndexFamily:
    """Sorted arrays of suffix prefixes, one per level, in one folder; levels of equal rank are merged.

    ``add`` makes a batch's array and scans it against all levels. The folder's
    last manifest names what belongs to the family, so that it can be opened
    later, by another session too.
    """

    COLUMNS = "gram binary, key long, m long"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 0):
        self.spark, self.root = spark, root
        self.buckets, self.made, self.levels, self.met = buckets or partitions_of(spark), 0, [], []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "IndexFamily":
        rows = spark.read.schema("version int, buckets int, made int, kind string, rank int, name string, nth int").json(f"{root}/manifest").collect()
        last = sorted((r for r in rows if r.version == max(x.version for x in rows)), key=lambda r: r.nth)
        family = cls(spark, root, last[0].buckets)
        family.made = last[0].made
        family.levels = [(r.rank, r.name) for r in last if r.kind == "level"]
        family.met = [r.name for r in last if r.kind == "met"]
        for _, name in family.levels:
            spark.sql(f"CREATE TABLE {family.table(name)} ({cls.COLUMNS}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {family.buckets} BUCKETS LOCATION '{root}/{name}'")
        return family

    def table(self, name: str) -> str:
        return f"textrine_{uuid.uuid5(uuid.NAMESPACE_URL, self.root + '#' + str(id(self))).hex}_{name}"

    def keep(self, array: DataFrame, rank: int) -> str:
        """An array as a bucketed table, each bucket one sorted file."""
        self.made += 1
        name = f"a{self.made}_{rank}"
        array.write.bucketBy(self.buckets, "gram").sortBy("gram").option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(self.table(name))
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.table(name))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, docs: DataFrame) -> None:
        """The batch's array, scanned against itself and each level; then equal ranks merge."""
        array = prefixes(docs).groupBy("gram", "key").agg(F.count("*").alias("m"))
        name = self.keep(array.repartition(self.buckets, "gram"), 0)
        array = self.read(name)
        found = array.where("m > 1").select("key")
        for _, level in self.levels:
            found = found.union(array.join(self.read(level).select("gram").hint("merge"), "gram").select("key"))
        found.write.option("compression", "zstd").parquet(f"{self.root}/met{self.made}")
        self.met.append(f"met{self.made}")
        self.levels.append((0, name))
        old = []
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self.keep(self.merged(a, b), rank + 1)))
            old += [a, b]
        self.save()
        for name in old:
            self.drop(name)

    def merged(self, a: str, b: str) -> DataFrame:
        """The merge of two sorted arrays, bucket by bucket."""
        x, y = self.read(a), self.read(b).toDF("gram", "key2", "m2")
        zero = F.lit(0)
        return x.join(y.hint("merge"), "gram", "full_outer").select(
            "gram", F.coalesce("key", "key2").alias("key"), (F.coalesce("m", zero) + F.coalesce("m2", zero)).alias("m")
        )

    def save(self) -> None:
        entries = [("level", rank, name) for rank, name in self.levels] + [("met", 0, name) for name in self.met]
        rows = [(self.made, self.buckets, self.made, *x, i) for i, x in enumerate(entries)]
        self.spark.createDataFrame(rows, "version int, buckets int, made int, kind string, rank int, name string, nth int").coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def candidates(self) -> DataFrame:
        """The key of every prefix that occurs twice."""
        return self.spark.read.schema("key long").parquet(*(f"{self.root}/{x}" for x in self.met)).distinct()

    def close(self, delete: bool = True) -> None:
        """Forget the tables; with ``delete`` their files too."""
        for _, name in self.levels:
            self.drop(name) if delete else self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}")
        for name in self.met if delete else ():
            self.drop(name)


ENTRY = "key long, s1 long, s2 long, tag long, did long, th long, a int, b int"


def tags(key: np.ndarray, did: np.ndarray, th: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of an entry's place."""
    return mix64(key + mix64(did.view(np.uint64) ^ mix64(th.view(np.uint64))) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def entries_of(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The entries whose prefix is a candidate, with the bytes [a, b) that they span.

    Candidates go to the text pass as a bitmap of fixed size. What passes by
    chance is alone in its class and prefix, and therefore never marked.
    """
    import pyarrow as pa

    shared = bitmap_of(candidates, "key")

    def run(batches):
        bits = shared.value
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for group in groups_of(batch.column(2)):
                row, at, p1, p2, key, buf, begin, _ = anchors(group)
                ok = np.flatnonzero(in_bitmap(bits, key))
                row, at, p1, p2, key = row[ok], at[ok], p1[ok], p2[ok], key[ok]
                s = digests(buf.tobytes(), begin[ok], p2 - p1 + LENGTH, at - p1)
                columns = [key.view(np.int64), np.ascontiguousarray(s[:, 0]), np.ascontiguousarray(s[:, 1]), tags(key, did[row], th[row], at).view(np.int64), did[row], th[row], p1.astype(np.int32), (p2 + LENGTH).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "s1", "s2", "tag", "did", "th", "a", "b"])

    return identified(docs).mapInArrow(run, ENTRY)


def spans_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """key, did, th, at, o (the anchor's place in the text and the span) and bytes of the entries with the ``chosen`` keys and tags.

    Both go as bitmaps. An entry that passes by chance does no harm: it is there,
    so any window that it shares with another does occur twice.
    """
    import pyarrow as pa

    keys, places = bitmap_of(chosen, "key"), bitmap_of(chosen, "tag")

    def run(batches):
        some, at_some = keys.value, places.value
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for group in groups_of(batch.column(2)):
                row, at, p1, p2, key, buf, begin, _ = anchors(group)
                hits = np.flatnonzero(in_bitmap(some, key))
                hits = hits[in_bitmap(at_some, tags(key[hits], did[row[hits]], th[row[hits]], at[hits]))]
                raw = buf.tobytes()
                for ok in np.array_split(hits, len(hits) // 8192 + 1):
                    cut = [raw[b : b + n] for b, n in zip(begin[ok].tolist(), ((p2 - p1)[ok] + LENGTH).tolist())]
                    columns = [key.view(np.int64)[ok], did[row[ok]], th[row[ok]], at[ok].astype(np.int32), (at - p1)[ok].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(cut, pa.binary())], ["key", "did", "th", "at", "o", "raw"])

    return identified(docs).mapInArrow(run, "key long, did long, th long, at int, o int, raw binary")


def semi_by_count(rows: DataFrame, counted: DataFrame, on: list[str], n: str, share: int) -> DataFrame:
    """The rows whose ``on`` stands in ``counted``.

    Values with more than ``share`` rows (column ``n``) are broadcast, not shuffled;
    with a share of a fixed part of a shuffle partition's rows they are few.
    """
    hot = F.broadcast(counted.where(F.col(n) > share).select(*on))
    rest = rows.join(hot, on, "left_anti").join(counted.where(F.col(n) <= share).select(*on), on, "left_semi")
    return rows.join(hot, on, "left_semi").union(rest)


def window_hashes(raws: list[bytes], keys: np.ndarray, offsets: np.ndarray):
    """Of every window of some spans: the span's number, the window's, and two hashes of key, offset and content; about PART bytes at a time."""
    sizes = np.array([len(r) for r in raws])
    steps = np.flatnonzero(np.diff(np.cumsum(sizes) // PART)) + 1
    if len(steps):
        found = [window_hashes(raws[a:b], keys[a:b], offsets[a:b]) for a, b in zip([0, *steps], [*steps, len(raws)])]
        of = np.repeat(np.array([0, *steps]), [len(x[0]) for x in found]) + np.concatenate([x[0] for x in found])
        return of, *(np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
    hs = hasher()
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(raws), np.uint8)
    n = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(raws)), n)
    w = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = (ends - sizes)[of] + w
    place = mix64(keys[of] + (offsets[of] - w).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return of, w, *(mix64(hs.substrings(hs.sums(buf, which), start, LENGTH) + place) for which in (0, 1))


def runs_of(of: np.ndarray, w: np.ndarray):
    """Maximal runs of consecutive windows as (span, first, last)."""
    if not len(of):
        return of, w, w
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (w[1:] != w[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(of)]]).astype(np.int64) - 1
    return of[first], w[first], w[last]


MARK = "did long, th long, a int, b int"


def compare(spans: DataFrame) -> DataFrame:
    """Marks (byte ranges) of the windows that two spans of one key and slice share.

    ``spans`` is dealt by key and slice; whole slices are compared at a time, as
    many as fit in about PART bytes.
    """
    import pyarrow as pa

    def flush(rows):
        raws = [r[5] for r in rows]
        of, w, h, h2 = window_hashes(raws, np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[4] for r in rows], np.int64))
        order = np.lexsort((h2, h))
        same = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        s, first, last = runs_of(of[hit], w[hit])
        start = np.array([r[3] - r[4] for r in rows], np.int64)[s]
        columns = [np.array([r[1] for r in rows], np.int64)[s], np.array([r[2] for r in rows], np.int64)[s], (start + first).astype(np.int32), (start + last + LENGTH).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["did", "th", "a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > PART and (held[-1][0], held[-1][6]) != (row[0], row[6]):
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    dealt = spans.select("key", "did", "th", "at", "o", "raw", "slice").repartition("key", "slice").sortWithinPartitions("key", "slice")
    return dealt.mapInArrow(run, MARK)


def sliced(spans: DataFrame, wide: DataFrame) -> DataFrame:
    """The spans with a column ``slice``; those of ``wide`` keys are cut in SLICES by their windows' offsets from the anchor."""
    width = (LENGTH - GRAM) // SLICES + 1
    rows = spans.join(F.broadcast(wide.select("key", F.lit(True).alias("wide"))), "key", "left")
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.when(F.col("wide"), SLICES - 1).otherwise(0))))
    rows = rows.withColumn("first", F.when(F.col("wide"), F.greatest(F.col("o") - (F.col("slice") + 1) * width + 1, F.lit(0))).otherwise(0))
    rows = rows.withColumn("last", F.when(F.col("wide"), F.least(F.col("o") - F.col("slice") * width, F.length("raw") - LENGTH)).otherwise(F.length("raw") - LENGTH))
    cut = F.when(F.col("wide"), F.substring("raw", F.col("first") + 1, F.col("last") - F.col("first") + LENGTH)).otherwise(F.col("raw"))
    return rows.where("first <= last").select("key", "did", "th", "at", (F.col("o") - F.col("first")).alias("o"), cut.alias("raw"), "slice")


def compare_counted(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """The same marks for hot keys: window hashes are counted across the cluster."""
    import pyarrow as pa

    def explode(batches):
        for batch in batches:
            key, did, th, at, o, raw = (c.to_pylist() for c in batch.columns)
            for i in range(0, len(key), 512):
                of, w, h, h2 = window_hashes(raw[i : i + 512], np.array(key[i : i + 512], np.int64).view(np.uint64), np.array(o[i : i + 512], np.int64))
                start = np.array(at[i : i + 512]) - np.array(o[i : i + 512])
                columns = [h.view(np.int64), h2.view(np.int64), np.array(did[i : i + 512], np.int64)[of], np.array(th[i : i + 512], np.int64)[of], (start[of] + w).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "h2", "did", "th", "a"])

    rows = scratch.keep(spans.select("key", "did", "th", "at", "o", "raw").mapInArrow(explode, "h long, h2 long, did long, th long, a int"), "windows")
    twice = rows.groupBy("h", "h2").agg(F.count("*").alias("rows")).where("rows > 1")
    share = rows.count() // (PER_TASK * partitions_of(rows.sparkSession)) + 1
    return semi_by_count(rows, scratch.keep(twice, "twice"), ["h", "h2"], "rows", share).select("did", "th", "a", (F.col("a") + LENGTH).alias("b"))


def batches_of(docs: DataFrame) -> int:
    """Two, and one more with each doubling of the input beyond BATCH_BYTES; by the plan's estimate, if it has one."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 2 + (size // BATCH_BYTES).bit_length() if size < 1 << 60 else 2


def marks(docs: DataFrame, scratch: Scratch, batches: int = 0, share: int = 0, group: int = GROUP) -> DataFrame:
    """Byte ranges [a, b) to remove, with overlaps; by did and th."""
    batches = batches or batches_of(docs)
    family = IndexFamily(docs.sparkSession, f"{scratch.root}/family")
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))
    for i in range(batches):
        family.add(docs.where(dealt == i))
    candidates = scratch.keep(family.candidates(), "candidates")
    family.close()
    return matches(docs, candidates, scratch, share, group)


def matches(docs: DataFrame, candidates: DataFrame, scratch: Scratch, share: int = 0, group: int = GROUP) -> DataFrame:
    """The marks of all matches at the candidate prefixes. ``share``: rows from which a class is hot, else by PER_TASK."""
    class_of = ["key", "s1", "s2"]
    entries = scratch.keep(entries_of(docs, candidates), "entries")
    classes = scratch.keep(entries.groupBy(*class_of).agg(F.count("*").alias("m"), F.min("tag").alias("tag")), "classes")
    share = share or entries.count() // (PER_TASK * partitions_of(docs.sparkSession)) + 1
    found = semi_by_count(entries, classes.where("m > 1").select(*class_of, "m"), class_of, "m", share).select("did", "th", "a", "b")

    several = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("m").alias("least")).where("classes > 1 AND least = 1")
    several = scratch.keep(several.select("key", "classes"), "several")
    spans = spans_of(docs, scratch.keep(semi_by_count(classes, several, ["key"], "classes", share).select("key", "tag"), "chosen"))
    most = several.agg(F.max("classes")).first()[0] or 0
    if most > group:
        hot = F.broadcast(several.where(F.col("classes") > group).select("key"))  # at most entries / GROUP of them
        spans = scratch.keep(spans, "spans")
        found = found.union(compare_counted(spans.join(hot, "key", "left_semi"), scratch))
        spans = spans.join(hot, "key", "left_anti")
    spans = sliced(spans, several.where(F.col("classes") > WIDE)) if most > WIDE else spans.withColumn("slice", F.lit(0))
    return found.union(compare(spans))


def removed_ranges(found: DataFrame) -> DataFrame:
    """did, th and the array of byte ranges of each document."""
    return found.groupBy("did", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def merged(ranges, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, min(b, size)])
    return [(a, min(b, size)) for a, b in out]


def dedup(docs: DataFrame, batches: int = 0, share: int = 0, group: int = GROUP, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether any byte goes), text (the characters kept) and (``with_bytes``) the kept bytes."""
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession, "suffix")
    ranges = scratch.keep(removed_ranges(marks(docs, scratch, batches, share, group)), "ranges")
    scratch.drop_all(ranges)
    keyed = identified(docs).withColumn("doc_id", F.when(F.col("did") != -(1 << 63), F.col("did")))
    joined = keyed.join(ranges, ["did", "th"], "left").select("doc_id", "text", F.col("ranges.a").alias("a"), F.col("ranges.b").alias("b"))

    def run(parts_):
        for batch in parts_:
            size, removed, spans, sha, left, kept = [], [], [], [], [], []
            for text, a, b in zip(*(c.to_pylist() for c in batch.columns[1:])):
                raw = (text or "").encode("utf-8", "surrogatepass")
                cuts = merged(zip(a, b), len(raw)) if a else []
                pieces = [raw[x:y] for x, y in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(raw)])]
                rest = b"".join(pieces)
                size.append(len(raw)), removed.append(len(raw) - len(rest)), spans.append(len(cuts))
                sha.append(hashlib.sha256(rest).hexdigest()), left.append("".join(x.decode("utf-8", "ignore") for x in pieces))
                if with_bytes:
                    kept.append(rest)
            columns = {"doc_id": batch.column(0), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "repeats": pa.array(np.array(removed, np.int64) > 0), "text": pa.array(left, pa.string())}
            if with_bytes:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, text string" + ", kept binary" * with_bytes)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
w AS (SELECT doc_id, p, md5(b[p : p + 399]) AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
m AS (SELECT doc_id, p, p + 399 AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
s AS (SELECT doc_id, p, q, CASE WHEN p > coalesce(max(q) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) + 1 THEN p END AS f FROM m),
r AS (SELECT doc_id, a, max(q) AS z FROM (SELECT doc_id, q, last_value(f IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) AS a FROM s) GROUP BY doc_id, a),
g AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a + 1) AS BIGINT) AS removed, count(*) AS spans FROM r GROUP BY doc_id),
c AS (SELECT doc_id, ch, i, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM (
  SELECT doc_id, unnest(x) AS ch, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM g)))),
k AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS t FROM c JOIN g USING (doc_id)
  WHERE NOT list_bool_or(list_transform(range(1, spans + 1), lambda j: q >= a[j] AND q - strlen(ch) + 1 <= z[j])) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN b ELSE list_reduce(list_transform(range(0, spans + 1), lambda i: b[CASE WHEN i = 0 THEN 1 ELSE z[i] + 1 END : CASE WHEN i = spans THEN octet_length(b) ELSE a[i + 1] - 1 END]), lambda x, y: x || y) END) AS kept_sha256,
  coalesce(removed, 0) > 0 AS repeats, CASE WHEN spans IS NULL THEN decode(b) ELSE coalesce(t, '') END AS text
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
