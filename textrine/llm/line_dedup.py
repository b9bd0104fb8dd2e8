"""Line dedup by winnowing over line hashes.

A text's lines (split at \\n, blank ones left out, compared without spaces,
tabs and carriage returns at their ends) are hashed. From each line on, the
window is the fewest lines that have RUN_CHARS characters together, or RUN
lines: a single line of some length, or up to three short ones. What a window
holds depends on its lines alone, so two equal runs have equal windows. Its line
with the smallest hash (the last of equal ones) is its fingerprint, so any
repeated run of RUN_CHARS characters or RUN lines has a common fingerprint,
whatever surrounds it. Only lone lines (or pairs) of under RUN_CHARS characters
are no run: brackets, numbers, one-word answers.

Fingerprint positions are joined by hash: those that occur once in the corpus
cannot lie in a repeated run and go. The others are extended both ways over the
windows that chose them; windows are compared by 128 hash bits, and each is
matched with its earliest occurrence only, so that no group is paired with
itself. Windows that overlap or touch join to maximal runs, and all lines of
runs that start later than their first occurrence are deleted.

Everything is DataFrame functions. Fingerprints and windows are counted before
they are shuffled; those with more than their share of rows (at most PER_TASK
for each shuffle partition) are broadcast instead.

Defined results: order is (doc_id, hash of text, line); null and empty texts
have no lines and stay; texts without a window stay; repeated rows (same id and
text) count as one document and get the same result; a null id sorts first;
other columns, of any names, pass through ``dedup_lines`` untouched; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textrine.llm.common import Scratch, partitions_of

#: A run has so many lines, or so many characters.
RUN, RUN_CHARS = 3, 20
#: A fingerprint or window is hot if it has more than 1 / PER_TASK of the rows that a shuffle partition gets on average.
PER_TASK = 4

FIRST_ID = -(1 << 63)


def line_arrays(docs: DataFrame) -> DataFrame:
    """did, th, and per text the array of non-blank lines as (pos, h1, h2, len)."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(" \t\r")).alias("line")))
    kept = F.filter(lines, lambda x: F.length(x["line"]) > 0)
    hashed = F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(17), x["line"]).alias("h2"), F.length(x["line"]).alias("len")))
    return docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)).alias("did"), F.xxhash64("text").alias("th"), hashed.alias("ls")
    )


def windows(arrays: DataFrame, run: int = RUN, chars: int = RUN_CHARS) -> DataFrame:
    """did, th, p1, p2 (first and last line), w1, w2 (hash) of each window, with its fingerprint fp and that line's number."""
    enough = " ".join(f"WHEN {' + '.join(f'get(ls, j + {i}).len' for i in range(k))} >= {chars} THEN {k}" for k in range(1, run))
    sized = arrays.select("did", "th", "ls", F.expr(f"transform(ls, (x, j) -> CASE {enough} ELSE {run} END)").alias("size"))
    made = F.expr("""transform(filter(sequence(0, size(ls) - 1), j -> j + size[j] <= size(ls)), j -> struct(
        array_max(transform(slice(ls, j + 1, size[j]), x -> struct(~x.h1 AS low, x.pos AS at))) AS one,
        ls[j].pos AS p1, ls[j + size[j] - 1].pos AS p2,
        xxhash64(transform(slice(ls, j + 1, size[j]), x -> x.h1)) AS w1,
        xxhash64(transform(slice(ls, j + 1, size[j]), x -> x.h2)) AS w2))""")
    rows = sized.where(F.size("ls") > 0).select("did", "th", F.explode(made).alias("w"))
    return rows.select("did", "th", F.col("w.one.low").alias("fp"), F.col("w.one.at").alias("at"), "w.p1", "w.p2", "w.w1", "w.w2")


def repeated_windows(arrays: DataFrame, scratch: Scratch) -> DataFrame:
    """did, th, p1, p2 of every window that occurred earlier."""
    found = scratch.keep(windows(arrays), "windows")
    share = found.count() // (PER_TASK * partitions_of(arrays.sparkSession)) + 1
    place = F.xxhash64("did", "th", "at")
    counted = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("rows")).where("a != b")
    counted = scratch.keep(counted.select("fp", "rows"), "fingerprints")
    hot = F.broadcast(counted.where(F.col("rows") > share).select("fp"))
    rest = found.join(hot, "fp", "left_anti").join(counted.where(F.col("rows") <= share).select("fp"), "fp", "left_semi")
    spans = found.join(hot, "fp", "left_semi").union(rest).select("did", "th", "p1", "p2", "w1", "w2")

    first = spans.groupBy("w1", "w2").agg(F.min(F.struct("did", "th", "p1")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = scratch.keep(first, "first")
    later = F.struct("did", "th", "p1") > F.col("first")
    hot = F.broadcast(first.where(F.col("rows") > share).drop("rows"))
    rest = spans.join(hot, ["w1", "w2"], "left_anti").join(first.where(F.col("rows") <= share).drop("rows"), ["w1", "w2"])
    return spans.join(hot, ["w1", "w2"]).where(later).select("did", "th", "p1", "p2").union(rest.where(later).select("did", "th", "p1", "p2")).distinct()


def runs(marked: DataFrame) -> DataFrame:
    """did, th and the sorted maximal runs of line numbers, as (a, b)."""
    order = Window.partitionBy("did", "th").orderBy("p1", "p2")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        marked.withColumn("reach", F.max("p2").over(before))
        .withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("p1") > F.col("reach") + 1), 1).otherwise(0)).over(order))
        .groupBy("did", "th", "run").agg(F.min("p1").alias("a"), F.max("p2").alias("b"))
    )
    return islands.groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def cut(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text without later repeated runs, n_lines, n_removed and n_runs."""
    scratch = Scratch(docs.sparkSession, "lines")
    found = scratch.keep(runs(repeated_windows(line_arrays(docs), scratch)), "runs")
    scratch.drop_all(found)
    # the row goes along as one struct, so that its columns may have any names
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)).alias("did"), F.xxhash64("text").alias("th"))
    joined = keyed.join(found, ["did", "th"], "left").withColumn("ls", F.split("row.text", "\n"))
    gaps = F.expr("""transform(sequence(0, size(runs)), i -> struct(
        if(i = 0, 0, runs[i - 1].b + 1) AS a, if(i = size(runs), size(ls), runs[i].a) AS b))""")
    rest = F.expr("array_join(flatten(transform(gaps, x -> slice(ls, x.a + 1, x.b - x.a))), '\n')")
    removed = F.expr("aggregate(runs, 0, (n, r) -> n + r.b - r.a + 1)")
    return joined.withColumn("gaps", gaps).select(
        "row",
        F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(rest).alias("text"),
        F.when(F.col("ls").isNull(), 0).otherwise(F.size("ls")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
    )


def rows_of(done: DataFrame, columns: list[str], **changed: F.Column) -> DataFrame:
    """The columns that a row had, with the new text and what else has changed."""
    changed = {"text": F.col("text")} | changed
    return done.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``."""
    return rows_of(cut(docs), docs.columns)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The same without the documents of which nothing is left; ``n_chars``, if there is one, follows the text."""
    done = cut(docs).where((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows_of(done, docs.columns, **changed)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256."""
    out = cut(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents WHERE text IS NOT NULL)),
w AS (
  SELECT doc_id, pos AS p1, CASE n WHEN 1 THEN pos WHEN 2 THEN q1 ELSE q2 END AS p2, CASE n WHEN 1 THEN s WHEN 2 THEN s || chr(10) || s1 ELSE s || chr(10) || s1 || chr(10) || s2 END AS k
  FROM (SELECT *, CASE WHEN length(s) >= 20 THEN 1 WHEN length(s) + length(s1) >= 20 THEN 2 ELSE 3 END AS n
        FROM (SELECT doc_id, pos, s, lead(pos, 1) OVER o AS q1, lead(s, 1) OVER o AS s1, lead(pos, 2) OVER o AS q2, lead(s, 2) OVER o AS s2
              FROM l WHERE s <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)))),
m AS (
  SELECT doc_id, p1, p2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p1) AS nth FROM w WHERE p2 IS NOT NULL) WHERE nth > 1),
r AS (
  SELECT doc_id, a, max(p2) AS b FROM (
    SELECT doc_id, p1, p2, last_value(start IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p1) AS a FROM (
      SELECT doc_id, p1, p2, CASE WHEN p1 > coalesce(max(p2) OVER (PARTITION BY doc_id ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) + 1 THEN p1 END AS start FROM m))
  GROUP BY doc_id, a),
k AS (
  SELECT l.doc_id, l.pos, l.line, r.a FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(a) AS BIGINT) AS n_removed, CAST(count(DISTINCT a) AS BIGINT) AS n_runs,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE a IS NULL) AS t
  FROM k GROUP BY doc_id) USING (doc_id)
"""
