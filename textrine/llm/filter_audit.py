"""Filter interaction audit: what five filters remove in every order.

Each text gets a mask of the filters that it fails. Four of them (A to D) are
functions of the text. The fifth, E, is "identical to the text of a smaller id"
and is found by a fingerprint-routed RDD:

1. Each task keeps chains of equal fingerprints (xxhash of the UTF-8 text) with
   full texts and smallest ids, some CHUNK_BYTES at a time. A row that is not the
   smallest of its text there is decided at once and travels without its text.
   One row for each distinct text goes on, so that a text which a third of all
   rows have is sent once for each chunk.
2. These rows are partitioned by fingerprint and sorted by it (the sort spills).
   A chain is as long as there are different texts with one fingerprint, mostly
   one; ids that are not its minimum are emitted with E.
3. Ids, parts and masks, without texts, meet the labels; ``combineByKey`` merges
   vectors of counts for each part: 32 masks by all, good and toxic documents.

All 120 orders follow from a part's 32 counts. Nothing is collected.

Defined results: a null text is empty, so empty and null texts are copies of one
another; a null ``lang`` is the part ''; a null id is greater than any other and
has no labels; rows that repeat an id are documents of their own, of which none
is a copy of the other; where labels repeat an id, one of its rows with quality
or toxic 1 is enough; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import partitions_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Texts that a task holds at once before it sends what it has.
CHUNK_BYTES = 16 << 20
#: Bytes of text for each partition of the routed texts.
ROUTED_BYTES = 256 << 20

UPPER = bytes(range(65, 91))
SIGNS = re.compile(rb"[#$%&*|]")

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails, as bits. ``raw``: its UTF-8."""
    words = raw.split()
    n = len(words)
    failed = [n < 200, 100 * len(set(words)) < 50 * n, 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * len(text), SIGNS.search(raw) is not None]
    return sum(1 << i for i, x in enumerate(failed) if x)


class Holders:
    """Who has the smallest id of one text: (null, id), mask, and rows of that id by part."""

    __slots__ = ("raw", "key", "mask", "parts")

    def __init__(self, raw: bytes, key: tuple, mask: int):
        self.raw, self.key, self.mask, self.parts = raw, key, mask, {}

    def rows(self, copy: int) -> list[tuple]:
        doc_id = None if self.key[0] else self.key[1]
        return [(doc_id, part, self.mask | copy, n) for part, n in self.parts.items()]

    def offer(self, key: tuple, parts: dict) -> list[tuple]:
        """Take rows of an id with this text; returns those that are now known to be copies."""
        if key > self.key:
            return [(None if key[0] else key[1], part, self.mask | COPY, n) for part, n in parts.items()]
        lost = [] if key == self.key else self.rows(COPY)
        if lost:
            self.key, self.parts = key, {}
        for part, n in parts.items():
            self.parts[part] = self.parts.get(part, 0) + n
        return lost


def first_of_chunk(rows: Iterable) -> Iterator[tuple]:
    """(fingerprint, (text, id key, mask, parts)) of each distinct text of a chunk, and (number, rows) of copies."""
    from xxhash import xxh64_intdigest

    chains: dict[int, list[Holders]] = {}
    copies: list[tuple] = []
    held = 0

    def sent():
        for h, chain in chains.items():
            for x in chain:
                yield h, (x.raw, x.key, x.mask, x.parts)
        if copies:  # decided already: any partition will do
            yield xxh64_intdigest(repr(copies[0]).encode()), (None, copies[:])

    for doc_id, text, part in rows:
        raw = text.encode("utf-8", "surrogatepass")
        h, key = xxh64_intdigest(raw), (doc_id is None, doc_id or 0)
        chain = chains.setdefault(h, [])
        here = next((x for x in chain if x.raw == raw), None)
        if here is None:
            here = Holders(raw, key, text_mask(text, raw))
            chain.append(here)
            held += len(raw) + 200
        copies += here.offer(key, {part: 1})
        if held > CHUNK_BYTES or len(copies) >= 2000:
            yield from sent()
            chains, copies, held = {}, [], 0
    yield from sent()


def judged_chains(routed: Iterable[tuple]) -> Iterator[tuple]:
    """(id, part, mask, rows) from records in order of their fingerprint: one chain at a time."""
    at, chain = None, []
    for h, record in routed:
        if h != at:
            for x in chain:
                yield from x.rows(0)
            at, chain = h, []
        if record[0] is None:
            yield from record[1]
            continue
        raw, key, mask, parts = record
        here = next((x for x in chain if x.raw == raw), None)
        if here is None:
            here = Holders(raw, key, mask)
            chain.append(here)
        yield from here.offer(key, parts)
    for x in chain:
        yield from x.rows(0)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: the failed filters of all documents (n rows of one id and text)."""
    empty = F.lit("")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", empty), F.coalesce("lang", empty))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions_of(docs.sparkSession), size // ROUTED_BYTES)
    routed = texts.rdd.mapPartitions(first_of_chunk).repartitionAndSortWithinPartitions(parts, lambda h: h % parts)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(judged_chains), "doc_id long, part string, mask int, n long", verifySchema=False)


def with_labels(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``masked`` with good and toxic (0 or 1)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    zero = F.lit(0)
    return masked.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))


def count_vectors(rows: RDD) -> RDD:
    """part -> counts of the 32 masks: documents, good ones, toxic ones, end to end."""

    def put(vector: list[int], x: tuple) -> list[int]:
        mask, n, good, toxic = x
        vector[mask] += n
        vector[MASKS + mask] += n * good
        vector[2 * MASKS + mask] += n * toxic
        return vector

    keyed = rows.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    return keyed.combineByKey(lambda x: put([0] * (3 * MASKS), x), put, lambda a, b: [x + y for x, y in zip(a, b)])


def orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """The rows of one part: all orders and steps, from its 32 counts of each kind."""
    every, good, toxic = (vector[k * MASKS : (k + 1) * MASKS] for k in range(3))
    bits = [1 << i for i in range(len(FILTERS))]
    # a document counts for the first of its failed filters: each is first in an equal share of the orders
    shapley = [sum(120 * every[m] // m.bit_count() for m in range(MASKS) if m & b) for b in bits]
    for order in permutations(range(len(FILTERS))):
        gone = 0
        for step, f in enumerate(order, 1):
            b = bits[f]
            here = [m for m in range(MASKS) if m & b and not m & gone]
            late = sum(every[m] for m in range(MASKS) if m & b and m & gone)
            gone |= b
            kept = sum(every[m] for m in range(MASKS) if not m & gone)
            lost = [sum(v[m] for m in here) for v in (every, good, toxic)]
            yield part, "".join(FILTERS[i] for i in order), step, kept, lost[0], late, every[b], lost[1], lost[2], shapley[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    vectors = count_vectors(with_labels(masks(docs), labels).rdd)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: orders(*x)), SCHEMA, verifySchema=False)


WORD = r"[^\x20\x09-\x0D]+"
ORACLE = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), known AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::int AS a, (100 * len(list_distinct(w)) < 50 * len(w))::int AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int AS c, regexp_matches(t, '[#$%&*|]')::int AS d,
    (min(x.doc_id) OVER (PARTITION BY t) < x.doc_id)::int AS e
  FROM texts x LEFT JOIN known k ON x.doc_id = k.doc_id
), masked AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::int AS gone FROM orders, (SELECT unnest(range(1, 6)) AS step)
), removals AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | coalesce(gone, 0)) = 0 THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) = 0 THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) > 0 THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) = 0 THEN good ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) = 0 THEN toxic ELSE 0 END)::bigint AS toxic_lost
  FROM masked, steps GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley
FROM removals
"""
