"""MinHash near-dedup by a multi-index Hamming join on b-bit signatures.

A document's set is its distinct 5-word shingles (A-Z folded, whole text; fewer
words: the whole sequence). Two documents are linked if 100 * intersection >=
75 * union, which is confirmed on the full sets.

1. One pass makes n_shingles, an order-free digest of the set (128 bits) and a
   signature of SYMBOLS minima of BITS bits. Equal sets are one class; only a
   class's smallest id goes on.
2. Pigeonhole: the signature is split into CHUNKS chunks of CHUNK symbols. If
   two signatures differ in at most 2 * CHUNKS - 1 symbols, some chunk has at
   most one wrong symbol, so enumerating "all but one symbol" of each chunk as
   join keys finds every such pair: DISTANCE = 19 of 40. A pair of similarity
   0.75 differs in 10 on average, and one without any common key has a
   probability of 2e-6 (farther pairs that meet are kept up to LOOSE symbols;
   a pair of similarity 0.75 is farther with a probability of 1e-5).
3. Groups are not paired with themselves. First each key's members meet one
   member only, the one that shares most keys; confirmed links make components.
   For some turns, members outside a key's largest component meet one member of
   it, another for each key and turn. What is then still apart is compared by
   pairs, but only documents that can have a link: those of whose shingles
   enough occur in any other document that is left, and only pairs that share a
   rare shingle or whose counts of frequent ones allow the similarity. A text
   with many changes of its own, of which a group of copies may have thousands,
   falls out here unpaired. Hot keys are counted before they are shuffled.
4. Components by label propagation with pointer jumping; nothing is collected.

Hot groups: a pair with a group's middle is joined to both sets by joins that
Spark may split; a key of more than BLOCK members is compared block by block.

Defined results: null and empty texts and texts without words have an empty
set, no links and their own component; rows with a null id are left out of
links and keep a null component; repeated rows are copies; rows with one id and
different texts are judged each by its own text, and ``filter_documents`` drops
just those that are not kept; its other columns, of any names, stay untouched;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import Scratch, WordHashes, batch_shingles, bitmap_of, distinct_per_text, give_back, in_bitmap, mix64, small_batches, text_slices

WORDS, PERCENT = 5, 75
CHUNKS, CHUNK, BITS = 10, 4, 14
SYMBOLS = CHUNKS * CHUNK
#: Symbols lie PER to a long, STEP bits apart: a spare bit each, and no sign bit.
PER, STEP = 4, BITS + 1
DISTANCE = 2 * CHUNKS - 1
LOOSE = 22
#: Turns of comparing with one member of a component before all members are.
TURNS = 1
#: Shingles that at most so many documents have, among those left, make pairs by themselves.
RARE = 8
LANES = SYMBOLS // PER
#: Members of a key that one task compares with as many others.
BLOCK = 2_000
#: Bytes of text whose shingles are in memory at once (and one text, if longer).
PART = 750_000

_rng = np.random.default_rng(20240229)
XORS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
ODDS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SYMBOLS x texts: BITS-bit minima of each non-empty text's distinct shingles."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((SYMBOLS, len(offsets) - 1), np.uint64)
    if len(rows):
        starts = offsets[:-1][rows]
        for s in range(SYMBOLS):
            low = np.minimum.reduceat((values ^ XORS[s]) * ODDS[s], starts)
            out[s, rows] = mix64(low) >> np.uint64(64 - BITS)
    return out


def digest(values: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """An order-free sum of each text's distinct shingles; 0 for an empty set."""
    starts = np.minimum(offsets[:-1], max(len(values) - 1, 0))
    sums = np.add.reduceat(mix64(values + np.uint64(k)), starts) if len(values) else np.zeros(len(offsets) - 1, np.uint64)
    return np.where(np.diff(offsets) > 0, sums, 0).astype(np.uint64).view(np.int64)


def distinct_sets(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """doc (smallest id), n, d1, d2, sig and id of each distinct set.

    ``id`` is the smallest doc_id. Where a doc_id is that of several sets (its rows
    have different texts), all but one of them get a hash of id and text instead.
    """
    sets = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("sig").alias("sig"))
    sets = scratch.keep(sets.select("n", "d1", "d2", "sig", F.col("one.doc_id").alias("doc"), F.col("one.th").alias("th")), "sets")
    shared = sets.groupBy("doc").agg(F.count("*").alias("sets"), F.min(F.struct("n", "d1", "d2")).alias("first")).where("sets > 1").drop("sets")
    if shared.isEmpty():
        return sets.withColumn("id", F.col("doc"))
    own = F.col("first").isNull() | (F.col("first") == F.struct("n", "d1", "d2"))
    named = sets.join(shared, "doc", "left").withColumn("id", F.when(own, F.col("doc")).otherwise(F.xxhash64("doc", "th")))
    return scratch.keep(named.select("doc", "n", "d1", "d2", "sig", "id"), "classes")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, d1, d2 (digest) and sig, LANES longs of packed symbols; no shuffle."""
    import pyarrow as pa

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), PART):
                values, offsets = distinct_per_text(*batch_shingles(texts, cache, WORDS))
                n = np.diff(offsets)
                symbols = signatures(values, offsets)
                lanes = [sum(symbols[PER * i + j] << np.uint64(STEP * j) for j in range(PER)).view(np.int64) for i in range(LANES)]
                d1, d2 = (digest(values, offsets, k) for k in (1, 2))
                sig = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(lanes).ravel()), LANES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(n), pa.array(d1), pa.array(d2), sig], ["doc_id", "th", "n", "d1", "d2", "sig"])
                del texts, values, offsets, symbols, lanes, sig
            del batch
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n long, d1 long, d2 long, sig array<long>")


def keys(classes: DataFrame) -> DataFrame:
    """slot, key, id: for each chunk, the hash of all but one of its symbols."""
    symbol = lambda s: f"(shiftrightunsigned(sig[{s // PER}], {STEP * (s % PER)}) & {(1 << BITS) - 1}L)"
    made = []
    for c in range(CHUNKS):
        for skip in range(CHUNK):
            rest = [symbol(c * CHUNK + j) for j in range(CHUNK) if j != skip]
            made.append(f"xxhash64({c * CHUNK + skip}, {', '.join(rest)})")
    return classes.select("id", F.posexplode(F.expr(f"array({', '.join(made)})")).alias("slot", "key"))


def lane_difference(a: str, b: str, i: int) -> str:
    """SQL: the number of symbols in which lane i of two packed signatures differs."""
    ones = sum(((1 << BITS) - 1) << (STEP * j) for j in range(PER))  # added to a symbol, it carries into the spare bit unless that is 0
    spare = sum(1 << (STEP * j + BITS) for j in range(PER))
    return f"bit_count((({a}[{i}] ^ {b}[{i}]) + {ones}L) & {spare}L)"


def differing(a: str, b: str) -> str:
    """SQL: the number of symbols in which two packed signatures differ."""
    return " + ".join(lane_difference(a, b, i) for i in range(LANES))


def first_shared(a: str, b: str, slot: str) -> str:
    """SQL: whether ``slot`` is the first key that two signatures share (a lane is a chunk).

    A pair may share many keys; with this condition a join makes it once.
    """
    lanes = [lane_difference(a, b, i) for i in range(LANES)]
    return "CASE " + " ".join(f"WHEN {d} <= 1 THEN {slot} = {CHUNK * i} OR ({slot} DIV {CHUNK} = {i} AND {d} = 1)" for i, d in enumerate(lanes)) + " ELSE false END"


def sets_of(ids: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, d1, set: the distinct shingles of the documents with these ids, each once, as a written table.

    Only texts that a bitmap of the ids lets through are cut into sets, so that
    texts are never shuffled; some other documents may pass, and rows that share
    an id, so that a set belongs to an id only together with its digest d1. Once
    the table is written, nothing needs the bitmap any more. Repeated rows are made
    one here, and only where there are any: a join of the table as it was written
    is one that Spark can split where a key is hot.
    """
    import pyarrow as pa

    shared = bitmap_of(ids.select("id").distinct().withColumn("hash", F.xxhash64("id")), "hash")

    def run(batches):
        cache, bits = WordHashes(), shared.value
        for batch in batches:
            ways = [in_bitmap(bits, batch.column(i).to_numpy()) for i in (1, 3)]
            keep = pa.array(ways[0] | ways[1])
            ways, batch = [w[ways[0] | ways[1]] for w in ways], batch.filter(keep)
            for a, b, texts in text_slices(batch.column(4), PART):
                values, offsets = distinct_per_text(*batch_shingles(texts, cache, WORDS))
                d1 = pa.array(digest(values, offsets, 1))
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                for way, column in zip(ways, (0, 2)):
                    chosen = pa.array(way[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(column)[a:b], d1, sets], ["id", "d1", "set"]).filter(chosen)
                del texts, values, offsets, sets
            del batch
            give_back()

    doc, other = F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    texts = docs.where("doc_id IS NOT NULL").select(doc.alias("id"), F.xxhash64(doc).alias("hash"), other.alias("other"), F.xxhash64(other).alias("other_hash"), "text")
    with small_batches(docs.sparkSession):
        sets = scratch.keep(texts.mapInArrow(run, "id long, d1 long, set array<long>"), name)
    shared.destroy()
    if not sets.groupBy("id", "d1").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        return sets
    single = scratch.keep(sets.dropDuplicates(["id", "d1"]), name)
    scratch.drop(sets)
    return single


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, da, b, db: distinct ids with digests) whose full sets are similar enough; of each pair one set is shuffled."""
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, scratch, f"{name}-sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("d1").alias(f"d{x}"), F.col("set").alias(f"s{x}"))
    both = (
        pairs.join(side("b"), ["b", "db"]).join(side("a"), ["a", "da"])
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))
    )
    return scratch.keep(both.where(f"100 * both >= {PERCENT} * (na + nb - both)").select("a", "b"), f"{name}-links")


def linkable(ids: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Those ids that can have a link among the others at all, and pairs by rare shingles.

    First: id, n, common, frequent. ``common`` counts the document's shingles that any
    other of the ids has; no intersection is larger, so a link needs 100 * common >=
    75 * n. Documents that fall out take their shingles along; two rounds are made.
    ``frequent`` counts those that more than RARE of the ids have.
    Second: id, s of shingles that 2 to RARE ids have. A link either shares one of
    these, or its intersection is among the frequent ones.
    """
    near = sets_of(ids, docs, scratch, "rest-sets")  # ids: id, d1
    alive = scratch.keep(near.join(ids, ["id", "d1"], "left_semi").select("id", "set"), "alive")
    scratch.drop(near)
    for _ in range(2):
        own = alive.select("id", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1")
        counts = own.groupBy("id").agg(F.count("*").alias("alone"))
        fewer = alive.join(counts, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).where(f"100 * (size(set) - alone) >= {PERCENT} * size(set)")
        last, alive = alive, scratch.keep(fewer.select("id", "set"), "linkable")
        scratch.drop(last)
    shingles = alive.select("id", F.explode("set").alias("s"))
    few = shingles.groupBy("s").agg(F.count("*").alias("df")).where(f"df <= {RARE}")
    rare = scratch.keep(shingles.join(few, "s"), "rare")
    counts = rare.groupBy("id").agg(F.count("*").alias("rare"), F.count(F.when(F.col("df") == 1, 1)).alias("alone"))
    size, zero = F.size("set"), F.lit(0)
    able = alive.join(counts, "id", "left").select("id", size.alias("n"), (size - F.coalesce("alone", zero)).alias("common"), (size - F.coalesce("rare", zero)).alias("frequent"))
    return scratch.keep(able, "able"), rare.where("df > 1").select("id", "s")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, label (smallest reachable id) of every id in a link.

    Each round takes the smallest label among neighbours and then the label of
    that label, so that rounds grow with the logarithm of a chain's length.
    """
    edges = scratch.keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = scratch.keep(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        heard = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("best"))
        told = labels.join(heard, F.col("id") == F.col("a"))
        # a label's own holder learns of a smaller one from its followers
        offers = F.array(F.struct("id", F.least("label", "best").alias("next"), F.col("label").alias("was")), F.struct(F.col("label").alias("id"), F.col("best").alias("next"), F.lit(None).cast("long").alias("was")))
        lowest = told.select(F.inline(offers)).groupBy("id").agg(F.min("next").alias("next"), F.max("was").alias("was"))
        far = labels.select(F.col("id").alias("at"), F.col("label").alias("far"))
        jumped = lowest.join(far, F.col("next") == F.col("at")).select("id", F.least("next", "far").alias("label"), "was")
        fresh = scratch.keep(jumped.select("id", "label", (F.col("label") < F.col("was")).alias("moved")), f"{name}-labels")
        moved = fresh.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = fresh
        if not moved:
            scratch.drop(edges)
            return labels.select("id", "label")


def joined_components(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` after further links: only links between components count, and only
    their labels are propagated."""
    at = lambda i: labels.select(F.col("id").alias(i), F.col("label").alias(f"l{i}"))
    between = (
        links.join(at("a"), "a", "left").join(at("b"), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b").distinct()
    )
    between = scratch.keep(between, f"{name}-between")
    if between.isEmpty():
        return labels
    moved = components(between, scratch, name).select(F.col("id").alias("from"), F.col("label").alias("to"))
    known = labels.join(moved, F.col("label") == F.col("from"), "left").select("id", F.coalesce("to", "label").alias("label"))
    fresh = moved.join(labels, F.col("from") == F.col("id"), "left_anti").select(F.col("from").alias("id"), F.col("to").alias("label"))
    return scratch.keep(known.union(fresh), f"{name}-labels")


def leads(labelled: DataFrame, turn: int) -> DataFrame:
    """key, lead, its label: one member of each key's most frequent component.

    Which member that is differs from key to key and turn to turn, so that a
    document with many keys meets many members of a component.
    """
    dealt = F.xxhash64(F.lit(turn), "key", "id")
    per = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.min(F.struct(dealt.alias("h"), "id")).alias("one"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "label", F.col("one.id").alias("lead"))).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    return top.select("key", "top.lead", F.col("top.label").alias("lead_label"))


def blocked(rows: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` for the two sides of a self-join by ``on``, with a column ``block``: the members of a
    value with more than BLOCK of them are dealt to blocks, and each two blocks meet in a task of their own."""
    large = rows.groupBy(on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    if large.isEmpty():
        one = rows.withColumn("block", F.lit(0))
        return one, one
    dealt = rows.join(F.broadcast(large), on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = dealt.select("*", mine.alias("mine"), every.alias("other")).drop("blocks")
    side = lambda x, y: cells.withColumn("block", F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).drop("mine", "other")
    return side("mine", "other"), side("other", "mine")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near")
    with small_batches(docs.sparkSession):
        sketches = scratch.keep(sketch(docs), "sketch")
    classes = distinct_sets(sketches, scratch)
    keyed = keys(classes)
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(keyed.join(shared, "key"), "members")

    side = lambda x: classes.select(F.col("id").alias(x), F.col("d1").alias(f"d{x}"), F.col("sig").alias(f"s{x}"))
    near = f"{differing('sa', 'sb')} <= {LOOSE}"

    def close(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.keep(pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(near).select("a", "da", "b", "db"), name)

    # first the member of most keys' weight, which is the middle of a group of copies
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    middle = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", -F.col("id"))).alias("top")).select("key", (-F.col("top.col2")).alias("lead"))
    pairs = members.join(middle, "key").where("id != lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
    tried = close(pairs, "star")
    labels = components(confirmed(tried, docs, scratch, "star"), scratch, "star")

    def labelled() -> DataFrame:
        return members.join(labels, "id", "left").select("key", "slot", "id", F.coalesce("label", "id").alias("label"))

    for turn in range(TURNS):
        now = scratch.keep(labelled(), "labelled")
        pairs = now.join(leads(now, turn), "key").where("label != lead_label").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
        fresh = close(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "turn")
        scratch.drop(now)
        if fresh.isEmpty():
            break
        labels = joined_components(labels, confirmed(fresh, docs, scratch, "turn"), scratch, "turn")
        tried = tried.union(fresh)

    # what is left: pairs of different components that share a key and can be links
    now = scratch.keep(labelled(), "labelled")
    split = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = scratch.keep(now.join(split, "key", "left_semi"), "rest")
    able, rare = linkable(rest.select("id").distinct().join(classes.select("id", "d1"), "id"), docs, scratch)
    able = able.join(classes.select("id", "d1", "sig"), "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    able = scratch.keep(able, "able")

    def meet(rows: DataFrame, on: str, bound: str, more: str) -> DataFrame:
        """Pairs of different components that meet in ``on`` and whose counts allow a link."""
        rows = scratch.keep(rows.join(able, "id"), "meet")
        x, y = (r.select(F.col(on).alias("on"), "block", *(F.col(c).alias(f"{c}_{i}") for c in ("id", "d1", "n", "label", "sig", bound, *(["slot"] if "slot" in rows.columns else [])))) for i, r in zip("ab", blocked(rows, on)))
        least = f"least({bound}_a, {bound}_b)"
        can = f"id_a < id_b AND label_a != label_b AND 100 * {least} >= {PERCENT} * (n_a + n_b - {least}) AND {differing('sig_a', 'sig_b')} <= {LOOSE}{more}"
        met = x.join(y, (x["on"] == y["on"]) & (x["block"] == y["block"]) & F.expr(can))
        return met.select(F.col("id_a").alias("a"), F.col("d1_a").alias("da"), F.col("id_b").alias("b"), F.col("d1_b").alias("db"))

    by_key = meet(rest.select("key", "slot", "id"), "key", "frequent", f" AND {first_shared('sig_a', 'sig_b', 'slot_a')}")
    cross = scratch.keep(by_key.union(meet(rare, "s", "common", "")), "met").distinct()
    cross = scratch.keep(cross.join(tried, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        labels = joined_components(labels, confirmed(cross, docs, scratch, "cross"), scratch, "cross")

    label = F.coalesce("label", "id")
    tagged = scratch.keep(classes.join(labels, "id", "left").select("n", "d1", "d2", "doc", label.alias("label")), "tagged")
    named = tagged.join(tagged.groupBy("label").agg(F.min("doc").alias("component")), "label").drop("label", "doc")
    named = scratch.keep(named, "components")
    scratch.drop_all(named, sketches)
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return (
        sketches.join(named, ["n", "d1", "d2"], "left")
        .select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return judged(docs).drop("th")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id, all columns."""
    dropped = judged(docs).where("NOT kept").select("doc_id", "th").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"))
    return rows.join(dropped, ["doc_id", "th"], "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + least(len(w), 5) - 1) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM m JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 75 * (zx.n + zy.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x WHERE r.c < e.y)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM r LEFT JOIN z USING (doc_id) GROUP BY doc_id
"""
