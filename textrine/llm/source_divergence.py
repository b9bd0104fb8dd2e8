"""Source divergence audit: how far the term frequencies of sources lie apart.

For each language the terms that stand in at least MIN_DOCS of its documents are
kept. Every source has a smoothed frequency of every kept term, in billionths; a
pair of sources has the sum of chi-square terms f over all kept terms. Only few
terms occur in a source, so the sum over all of them is never made:

* V * f(zero, zero), as if no term occurred in either source;
* for either source, the histogram of its counts prices what terms that only it
  has change (one term of a histogram for all terms of one count);
* a join of postings (language, term, source, count) corrects the terms that
  both have: f(both) - f(one, zero) - f(zero, other) + f(zero, zero).

Counts are summed in each task over a bounded number of terms before they are
shuffled. The join's rows are sums by pair at once. All numbers are longs: f and
all sums of it stay under about 1e18, and ANSI arithmetic would fail rather than
wrap. A quotient of a billion times a count is divided in three steps of a
thousand, exact up to 9e15 occurrences.

Defined results: null text, lang and source are ''; a repeated row is a document
of its own (ids are not read); a source of a language without kept terms has
pairs of value 0; a language with one source has no pairs; an empty table gives
no rows; ties are ranked by term or source in the order of their UTF-8.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textrine.llm.common import Scratch

MIN_DOCS, TOP = 3, 200
#: Distinct (language, source, term) that a task sums before it sends them.
HELD_TERMS = 300_000
#: Bytes of UTF-8 that are no part of a term become spaces, A-Z small letters.
FOLD = bytes(32 if b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each source."""
    import pyarrow as pa

    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (n, df) in held.items():
                terms = list(n)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    columns = [[lang] * len(some), [source] * len(some), [t.decode() for t in some], [n[t] for t in some], [df[t] for t in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2)], names)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                df.update(set(words))
            if sum(len(x) for x, _ in held.values()) > HELD_TERMS:
                yield from sent()
        yield from sent()

    found = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    part = found.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def per_billion(count: str, total: str) -> str:
    """SQL: 1 + floor(1e9 * (count + 1) / total) for count < total, in longs."""
    a, d = f"(({count} + 1L) * 1000L)", f"greatest({total}, 1L)"
    b = f"({a} % {d} * 1000L)"
    c = f"({b} % {d} * 1000L)"
    return f"(1L + {a} div {d} * 1000000L + {b} div {d} * 1000L + {c} div {d})"


def divergence(p: str, q: str) -> str:
    """SQL: floor((p - q)^2 / q)."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_postings(counts: DataFrame) -> DataFrame:
    """lang, term, source, n, n_lang: occurrences of kept terms in sources and whole languages."""
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    return counts.select("lang", "term", "source", "n").join(terms.drop("docs"), ["lang", "term"])


def priced_groups(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, total, total_lang, zero: the denominators, and what a term that does not occur has, for every source of a language."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_source = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = postings.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    all_of = groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "total_lang", "kept"])
    known = all_of.select("lang", "source", "kept", (F.col("total") + F.col("kept")).alias("total"), (F.col("total_lang") + F.col("kept")).alias("total_lang"))
    return known.withColumn("zero", F.when(F.col("kept") > 0, F.expr(per_billion("0L", "total"))).otherwise(zero + 1))


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each source from each other one of its language."""
    one, other = groups.alias("g"), groups.alias("h")
    both = one.join(other, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source")))
    pairs = both.select("g.lang", "g.source", F.col("h.source").alias("item"), "g.kept", F.col("g.zero").alias("zg"), F.col("h.zero").alias("zh"))
    empty = divergence("zg", "zh")
    whole = pairs.select("lang", "source", "item", F.expr(f"kept * {empty}").alias("value"))
    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    left = pairs.join(histogram, ["lang", "source"]).select("lang", "source", "item", F.expr(f"terms * ({divergence('p', 'zh')} - {empty})").alias("value"))
    right = pairs.join(histogram.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr(f"terms * ({divergence('zg', 'p')} - {empty})").alias("value"))
    a = postings.select("lang", "term", "source", F.col("p").alias("pg"), F.col("zero").alias("zg"))
    b = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("ph"), F.col("zero").alias("zh"))
    shared = f"{divergence('pg', 'ph')} - {divergence('pg', 'zh')} - {divergence('zg', 'ph')} + {empty}"
    overlap = a.join(b, ["lang", "term"]).where("source != item").select("lang", "source", "item", F.expr(shared).alias("value"))
    sums = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (left, right, overlap)]
    return whole.union(sums[0]).union(sums[1]).union(sums[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(postings: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a source has more of than its language."""
    return postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and each source's TOP terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.keep(term_counts(docs), "counts")
    kept = scratch.keep(kept_postings(counts), "kept")
    groups = scratch.keep(priced_groups(docs, kept), "groups")
    priced = kept.join(groups, ["lang", "source"]).withColumns({"p": F.expr(per_billion("n", "total")), "q": F.expr(per_billion("n_lang", "total_lang"))})
    postings = scratch.keep(priced.select("lang", "term", "source", "p", "q", "zero"), "postings")
    scratch.drop(counts, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_values(postings, groups), "pair").union(ranked(term_values(postings), "term").where(F.col("rank") <= TOP))


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
  SELECT lang, source, d, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), of_lang AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3
), of_source AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN of_lang k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM of_lang GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN of_source s ON g.lang = s.lang AND g.source = s.source GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(s.n, 0) + 1) // (g.total + v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + v)::HUGEINT AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN of_lang k ON k.lang = g.lang
  LEFT JOIN of_source s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0)::bigint AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source != h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::bigint AS value FROM cells WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
