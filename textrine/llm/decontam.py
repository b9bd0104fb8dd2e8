"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is contaminated by a test item if at least PERCENT % of the item's
distinct 5-word shingles (A-Z folded) are among the document's. A whole long
document's MinHash says nothing about a short item, so both sides are
partitioned by size: items with 2^i to 2^(i+1)-1 shingles are sought in windows
of three blocks of 2^i shingles (a document's shingles in order), so that a
contiguous copy lies within one window and has there a similarity of 0.23 at
least. Signatures have SYMBOLS minima; blocks of a larger partition take the
minima of two blocks of the next smaller one. A window and an item that share
any minimum are candidates (a miss has a probability of 4e-6 at worst, and 1e-7
for a whole copy); each is verified by exact containment of the shingle sets.
Items under SMALL shingles are sought shingle by shingle, and items of fewer
than five words as a sequence of that many words, without sketches.

The benchmark is the stated query set: its sets are written once and broadcast in
blocks of about BLOCK_SHINGLES shingles, one pass over the documents for each
block; documents are not shuffled. One block alone is searched lazily; of several,
each block's finds are written and its broadcast released before the next one.

Defined results: null and empty documents match nothing; null items and items
without words are left out; repeated items (same id) match each for themselves;
extra columns pass through ``filter_documents`` untouched; empty tables give no
rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import Scratch, WordHashes, distinct_per_text, shingle_hashes, text_slices, text_words

WORDS, PERCENT = 5, 75
SYMBOLS, SMALL = 48, 8
#: Shingles of items that are broadcast at once: 8 bytes each, and as many for signatures.
BLOCK_SHINGLES = 1_000_000
PART = 1_500_000

_rng = np.random.default_rng(5)
XORS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
ODDS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Index:
    """Items by size class, with the sorted minima of each class and symbol."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]]):
        """items: (item_id, words to a shingle, sorted distinct shingles)."""
        self.items = items
        self.small: dict[int, list[int]] = {}
        classes: dict[int, list[int]] = {}
        for k, (_, words, shingles) in enumerate(items):
            if words < WORDS or len(shingles) < SMALL:
                self.small.setdefault(words, []).append(k)
            else:
                classes.setdefault(len(shingles).bit_length() - 1, []).append(k)
        self.classes = {}
        for c, members in sorted(classes.items()):
            low = np.array([[((items[k][2] ^ x) * o).min() for k in members] for x, o in zip(XORS, ODDS)])
            order = np.argsort(low, axis=1)
            self.classes[c] = (np.take_along_axis(low, order, 1), np.array(members)[order])

    def candidates(self, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minimum in some window."""
        found: set[tuple[int, int]] = set()
        if not len(hashes) or not self.classes:
            return found
        first = min(self.classes)
        counts = np.diff(offsets)
        pieces = -(-counts // (1 << first))
        starts = np.repeat(offsets[:-1], pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) << first)
        owner = np.repeat(np.arange(len(counts)), pieces)
        for s in range(SYMBOLS):
            low = np.minimum.reduceat((hashes ^ XORS[s]) * ODDS[s], starts)
            level = first
            for c, (sorted_low, members) in self.classes.items():
                while level < c:
                    low = np.minimum.reduceat(low, np.arange(0, len(low), 2))
                    level += 1
                wide = low.copy()
                wide[:-1] = np.minimum(wide[:-1], low[1:])
                wide[:-2] = np.minimum(wide[:-2], low[2:])
                values = sorted_low[s]
                at = np.minimum(np.searchsorted(values, wide), len(values) - 1)
                step = 1 << (c - first)
                for j in np.flatnonzero(values[at] == wide):
                    texts = np.unique(owner[j * step : (j + 3) * step])
                    k = at[j]
                    while k < len(values) and values[k] == wide[j]:
                        found.update((int(t), int(members[s][k])) for t in texts)
                        k += 1
        return found

    def small_candidates(self, hashes: np.ndarray, offsets: np.ndarray, words: int) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for k in self.small.get(words, ()):
            at = np.flatnonzero(np.isin(hashes, self.items[k][2]))
            found.update((int(t), k) for t in np.unique(np.searchsorted(offsets, at, "right") - 1))
        return found


def windows_of(lists: list[np.ndarray], n: int):
    """n-word shingles in order; texts of fewer words have none here unless n < WORDS."""
    counts = np.array([len(x) for x in lists])
    flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.uint64)
    hashes, offsets = shingle_hashes(flat, counts, n)
    if n < WORDS:  # only full windows: a shorter text's whole sequence is no n-word window
        keep = np.repeat(counts >= n, np.diff(offsets))
        sizes = np.where(counts >= n, np.diff(offsets), 0)
        return hashes[keep], np.concatenate([[0], np.cumsum(sizes)])
    return hashes, offsets


def item_sets(benchmark: DataFrame) -> DataFrame:
    """item_id, words to a shingle (fewer than five for shorter items), set."""
    import pyarrow as pa

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            ids, words, sets = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = text_words(text)
                if item is not None and w:
                    n = min(len(w), WORDS)
                    hashes = shingle_hashes(np.array([cache[x] for x in w], np.uint64), np.array([len(w)]), n)[0]
                    ids.append(item), words.append(n), sets.append(np.unique(hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "words", "set"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, words int, set array<long>")


_index: dict[str, Index] = {}


def item_blocks(benchmark: DataFrame, scratch: Scratch) -> tuple[int, Callable[[int], list]]:
    """The number of blocks of about BLOCK_SHINGLES shingles, and a function that reads one of them."""
    sets = scratch.keep(item_sets(benchmark), "items")
    total = sets.agg(F.sum(F.size("set")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_SHINGLES)

    def block(i: int) -> list[tuple[int, int, np.ndarray]]:
        rows = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        return [(r.item_id, r.words, np.array(r.set, np.int64).view(np.uint64)) for r in rows]

    return blocks, block


FOUND = "doc_id long, th long, item_id long, n_shared long, n_item long"


def finds(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_shared, n_item of every contaminated pair."""
    scratch = Scratch(docs.sparkSession, "decontam")
    blocks, block = item_blocks(benchmark, scratch)
    if blocks == 0:
        return docs.sparkSession.createDataFrame([], FOUND)
    if blocks == 1:
        found = search(docs, shared_items(docs, block(0)))
        scratch.drop_all()
        return found
    parts = []
    for i in range(blocks):
        shared = shared_items(docs, block(i))
        parts.append(scratch.keep(search(docs, shared), "found"))
        shared.destroy()
    scratch.drop_all(*parts)
    return reduce(DataFrame.union, parts)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every contaminated pair."""
    return finds(docs, benchmark).drop("th").withColumn("containment", F.col("n_shared") / F.col("n_item"))


def shared_items(docs: DataFrame, items: list) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def searcher(shared: Broadcast):
    """A function from an Arrow column of texts to (text number, item, n_shared, n_item), for use on executors."""

    def find(column, cache: WordHashes):
        token, items = shared.value
        if token not in _index:
            _index.clear()
            _index[token] = Index(items)
        index = _index[token]
        look = cache.__getitem__
        for a, _, texts in text_slices(column, PART):
            lists = [np.array(list(map(look, text_words(t))), np.uint64) for t in texts]
            hashes, offsets = windows_of(lists, WORDS)
            pairs = index.candidates(hashes, offsets)
            shingles = {WORDS: (hashes, offsets)}
            for n in index.small:
                shingles.setdefault(n, windows_of(lists, n))
                pairs |= index.small_candidates(*shingles[n], n)
            for t, k in sorted(pairs):
                item, words, wanted = index.items[k]
                h, o = shingles[words]
                n = int(np.isin(wanted, h[o[t] : o[t + 1]]).sum())
                if 100 * n >= PERCENT * len(wanted):
                    yield a + t, item, n, len(wanted)

    return find


def search(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """One pass over the documents for one block of items; no shuffle."""
    import pyarrow as pa

    find = searcher(shared)

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = [(ids[t], hashes[t], *rest) for t, *rest in find(batch.column(1), cache)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "th", "item_id", "n_shared", "n_item"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, FOUND)


def without(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """The rows in whose text no item of the block is found."""
    import pyarrow as pa

    find, at = searcher(shared), docs.columns.index("text")

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in find(batch.column(at), cache)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no test item contaminates, with their columns.

    With one block, rows pass through the search itself, so that no text is
    shuffled. With several, the finds of all blocks are joined back by id and
    hash of the text, so that rows which share an id are judged by their own text.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    blocks, block = item_blocks(benchmark, scratch)
    items = block(0) if blocks == 1 else []
    scratch.drop_all()
    if blocks <= 1:
        return without(docs, shared_items(docs, items)) if items else docs
    found = finds(docs, benchmark).select(F.col("doc_id").alias("did"), F.col("th").alias("hash")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("did")) & (F.xxhash64("row.text") == F.col("hash")), "left_anti")
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE = """
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, list_slice(w, p, p + least(len(w), 5) - 1) AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (
  SELECT DISTINCT doc_id, n, list_slice(w, p, p + n - 1) AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM q))),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM h JOIN q USING (n, s) GROUP BY doc_id, item_id),
z AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM m JOIN z USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""
