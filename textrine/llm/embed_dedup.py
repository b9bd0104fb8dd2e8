"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are compared within a label. Scaled to length 1, a cosine of 0.93 is a
distance of 0.374. Each table hashes a vector by a number of random projections,
each shifted and cut into cells of WIDTH; vectors in one bucket of a table are
compared by their exact cosine in double precision.

1. One Arrow pass checks vectors and names equal ones (128-bit digest). Equal
   vectors of a label are one class with a weight; only classes are hashed.
2. Projections for each table follow from the largest label's number of classes,
   so that about CHANCE unrelated vectors share a bucket with one at any size;
   tables follow from that, so that a pair at the threshold is missed by all of
   them with a probability of MISS (closer pairs far less). Projections are
   sums of whole numbers below 2^53, hence the same in every task and order.
3. Buckets are counted before vectors are shuffled. A bucket of more than BLOCK
   classes is dealt to blocks, and each two blocks meet in a group of their own.
   A group leaves one row for each linked vector: the weight of its links and the
   smallest id of its component there. A pair that shares several tables counts
   in the first of them alone, which both vectors' keys tell. Pairs are never rows.
4. Components by label propagation over (vector, smallest of its component).

Comparisons in a tight group of different vectors grow with the square of its
size, as exact link counts ask for; rows and memory do not.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; so do vectors of
different length. Rows with a null id link with nothing, have a null component
and are kept. Repeated rows are vectors of their own, each linked with the other;
rows that share an id but not the vector have each its own links and one
component. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import GOLD, Scratch, mix64
from textrine.llm.near_dup import components

COSINE = 0.93
#: Width of a cell for vectors of length 1.
WIDTH = 2.0
#: Unrelated vectors that share a bucket with one, about; and the probability that a pair at the threshold shares none.
CHANCE, MISS = 256, 1e-4
#: Classes of one bucket that are compared with as many others in one group.
BLOCK = 1_000
SEED = 29
#: Vectors and projections are whole multiples of 2^-20 and 2^-10, products of 2^-30.
VECTOR_UNIT, DIRECTION_UNIT = 1 << 20, 1 << 10


def meeting(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at a distance fall in one cell of a random projection."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan(n: int) -> tuple[int, int]:
    """(projections, tables) for n vectors of a label."""
    near, far = meeting(sqrt(2 - 2 * COSINE)), meeting(sqrt(2))
    k = max(1, ceil(log(max(n, 1) / CHANCE) / -log(far)))
    return k, ceil(log(MISS) / log(1 - near**k))


@lru_cache(4)
def directions(dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, count])
    width = int(WIDTH * VECTOR_UNIT * DIRECTION_UNIT)
    return np.rint(rng.standard_normal((dim, count)) * DIRECTION_UNIT), rng.integers(0, width, count)


def bucket_keys(unit: np.ndarray, spaces: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket of each vector (rows) in each table (columns), as 64-bit numbers that tell spaces and tables apart."""
    lines, shift = directions(unit.shape[1], k * tables)
    cells = (np.rint(unit * VECTOR_UNIT) @ lines).astype(np.int64) + shift
    cells //= int(WIDTH * VECTOR_UNIT * DIRECTION_UNIT)
    cells = cells.astype(np.uint64).reshape(len(unit), tables, k)
    out = mix64(spaces.astype(np.uint64)[:, None] + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(GOLD))
    for j in range(k):
        out = mix64(out ^ (cells[:, :, j] + np.uint64((j + 1) * GOLD % (1 << 64))))
    return out.astype(np.int64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # squares must not overflow
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def read_rows(column, element: str) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), element).reshape(len(column), -1)


def element_of(vectors: DataFrame) -> str:
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def named(vectors: DataFrame, with_vectors: bool) -> DataFrame:
    """vec_id, node (digest of label and vector; null where a row links with nothing), and with_vectors: space, dim, vec."""
    import pyarrow as pa
    import pyarrow.compute as pc

    element = element_of(vectors)
    more = {"space": pa.int64(), "dim": pa.int32(), "vec": pa.binary()} if with_vectors else {}

    def run(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            ids, label, column = batch.column(0), batch.column(1), batch.column(2)
            n = len(batch)
            node, space, vec = [None] * n, [None] * n, [None] * n
            dims = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            usable = dims * pc.and_(pc.is_valid(ids), pc.is_valid(label)).to_numpy(zero_copy_only=False)
            values, starts = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()[:-1]
            names = label.to_pylist()
            for dim in np.unique(usable[usable > 0]):
                at = np.flatnonzero(usable == dim)
                rows = values[starts[at][:, None] + np.arange(dim)]
                good = np.isfinite(rows).all(1) & (rows != 0).any(1)
                for i, row in zip(at[good], rows[good].astype(element)):
                    raw, head = row.tobytes(), f"{dim}:{names[i]}:".encode()
                    node[i], vec[i] = xxh3_128_digest(head + raw), raw
                    space[i] = xxh3_64_intdigest(head, 1) - (1 << 63)
            out = [ids, pa.array(node, pa.binary())]
            if with_vectors:
                out += [pa.array(space, pa.int64()), pa.array(dims, pa.int32()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "node", *more])

    read = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return read.mapInArrow(run, "vec_id long, node binary" + (", space long, dim int, vec binary" if with_vectors else ""))


def bucketed(classes: DataFrame, element: str, k: int, tables: int, with_vectors: bool) -> DataFrame:
    """key, node of each class in each table, and with_vectors: space, rep, weight, vec."""
    import pyarrow as pa

    names = ["key", "node"] + (["space", "rep", "weight", "vec"] if with_vectors else [])

    def run(batches):
        for batch in batches:
            dims, spaces = batch.column("dim").to_numpy(), batch.column("space").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 2000):
                    some = at[lo : lo + 2000]
                    rows = batch.take(pa.array(some))
                    keys = bucket_keys(unit_rows(read_rows(rows.column("vec"), element)), spaces[some], k, tables)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), *(rows.column(c) for c in names[1:])], names)

    return classes.mapInArrow(run, "key long, node binary" + (", space long, rep long, weight long, vec binary" if with_vectors else ""))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def linked(unit, key, spaces, blocks, weight, k, tables):
    """Links of one group that count here: (rows with links, the weight of each one's links, its smallest reachable row)."""
    n = len(unit)
    first, second = [], []
    for lo in range(0, n, 256):
        near = unit[lo : lo + 256] @ unit.T >= COSINE
        near &= np.arange(n) > np.arange(lo, min(lo + 256, n))[:, None]
        if blocks.min() != blocks.max():  # two blocks: their own pairs are compared elsewhere
            near &= blocks[lo : lo + 256, None] != blocks
        near &= spaces[lo : lo + 256, None] == spaces
        a, b = np.nonzero(near)
        first.append(a + lo)
        second.append(b)
    a, b = np.concatenate(first), np.concatenate(second)
    if not len(a):
        return a, a, a
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    keys = bucket_keys(unit[rows], spaces[rows], k, tables)
    here = int(np.argmax(keys[0] == key))
    for t in range(here):
        new = keys[a, t] != keys[b, t]
        a, b = a[new], b[new]
    total = np.bincount(a, weight[rows][b], len(rows)) + np.bincount(b, weight[rows][a], len(rows))
    some = np.flatnonzero(total)
    return rows[some], total[some].astype(np.int64), rows[local_components(len(rows), a, b)[some]]


def links_of(cells: DataFrame, element: str, k: int, tables: int) -> DataFrame:
    """node, links, rep, lead from cells in order of (key, x, y): one group at a time."""
    import pyarrow as pa

    out_names = ["node", "links", "rep", "lead"]

    def solve(group):
        group = group.sort_by([("rep", "ascending"), ("node", "ascending")])
        column = lambda c: group.column(c).to_numpy()
        unit = unit_rows(read_rows(group.column("vec"), element)) if len(set(map(len, group.column("vec").to_pylist()))) == 1 else None
        if unit is None:  # keys of different spaces that are equal by chance: nothing is lost, both are compared alone
            sizes = np.array([len(v) for v in group.column("vec").to_pylist()])
            for s in np.unique(sizes):
                yield from solve(group.take(pa.array(np.flatnonzero(sizes == s))))
            return
        rows, links, lead = linked(unit, column("key")[0], column("space"), column("mine"), column("weight"), k, tables)
        if len(rows):
            rep = column("rep")
            yield pa.RecordBatch.from_arrays([pa.array(group.column("node").take(pa.array(rows)).to_pylist(), pa.binary()), pa.array(links), pa.array(rep[rows]), pa.array(rep[lead])], out_names)

    def run(batches):
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            held = held.combine_chunks()
            if not len(held):
                continue
            marks = np.column_stack([held.column(c).to_numpy() for c in ("key", "x", "y")])
            bounds = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo > 1:
                    yield from solve(held.slice(lo, hi - lo))
            rest = held.slice(bounds[-1])
        if rest is not None and len(rest) > 1:
            yield from solve(rest)

    return cells.mapInArrow(run, "node binary, links long, rep long, lead long")


def in_cells(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with the cell (key, x, y) of blocks in which each is compared, and its own block ``mine``."""
    large = keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(large, "key", "left")
    mine = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("mine", mine).withColumn("other", other).withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("blocks", "other")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    element = element_of(vectors)
    scratch = Scratch(vectors.sparkSession, "embed-dedup")
    one = named(vectors, True).where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), *(F.first(c).alias(c) for c in ("space", "dim", "vec")))
    classes = scratch.keep(one, "classes")
    k, tables = plan(classes.groupBy("space").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    cells = in_cells(bucketed(classes, element, k, tables, True), bucketed(classes, element, k, tables, False))
    grouped = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = scratch.keep(links_of(grouped, element, k, tables), "links")
    label = components(found.where("rep != lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")), scratch, "embed")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = (
        classes.select("node", "rep", "weight").join(counts, "node", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
        .select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("label", "rep").alias("component"))
    )
    out = named(vectors, False).join(told, "node", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached AS (
  SELECT a AS id, a AS far FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.far = l.a
), labels AS (
  SELECT id, min(far) AS component FROM reached GROUP BY id
), counts AS (
  SELECT a AS id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.id LEFT JOIN counts c ON e.vec_id = c.id
"""
