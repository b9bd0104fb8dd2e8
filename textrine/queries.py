"""Registered queries and their DuckDB SQL.

Every query runs over a whole table and whole texts. Tree queries come over
``benchmark`` (and ``part``) where SQL can enumerate all substrings, and over
``documents``, where only the kernel can; those are held against brute force in
the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrine import options
from textrine.functions import numeric
from textrine.operators import large, memory, navigate, partitions, search, traverse, trees, windows
from textrine.sources import blocks, files, text
from textrine.sources.scratch import Scratch
from textrine.streaming import windows as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BLOCK, ACTIVE = 4, 2
SIZE = BLOCK * ACTIVE
PATTERNS = ["the ", "ation", "and", "z", "ció"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.texts_of(spark, sf_dir, "benchmark", "item_id", "text")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.texts_of(spark, sf_dir, "part", "p_partkey", "p_name")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.texts_of(spark, sf_dir, "documents", "doc_id", "text")


LCP = "coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: substr({a}, 1, k) = substr({b}, 1, k))), 0)"


def tree(source: str = "SELECT item_id AS doc_id, text AS s FROM benchmark") -> str:
    """Nodes (nd), children (ch) and edges (ed) of the suffix trees of a source, by all substrings."""
    return f"""
WITH t AS ({source}),
suf AS (SELECT doc_id, s, length(s) AS n, unnest(range(1, length(s) + 2)) AS i FROM t),
sub AS (SELECT doc_id, n, i, l, substr(s, i, l) AS w, CASE WHEN i + l = n + 1 THEN '$END' ELSE substr(s, i + l, 1) END AS nc
        FROM (SELECT *, unnest(range(0, n + 2 - i)) AS l FROM suf)),
occ AS (SELECT doc_id, i, w, nc, first_value(nc) OVER (PARTITION BY doc_id, w ORDER BY i) AS fc FROM sub),
br AS (SELECT doc_id, w, length(w) AS depth, min(i) AS leftmost, CASE WHEN w = '' THEN 0 ELSE min(CASE WHEN nc <> fc THEN i END) END AS head_position, count(DISTINCT nc) AS n_children
       FROM occ GROUP BY doc_id, w HAVING w = '' OR count(DISTINCT nc) > 1),
nd AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY head_position) AS INTEGER) AS node_id FROM br),
ch AS (SELECT doc_id, node_id AS child, depth AS child_depth, w AS path, head_position AS start FROM nd WHERE depth > 0
       UNION ALL SELECT doc_id, -i, n - i + 2, substr(s, i) || chr(1114111), i FROM suf),
anc AS (SELECT c.*, p.node_id AS parent, p.depth AS parent_depth, row_number() OVER (PARTITION BY c.doc_id, c.child ORDER BY p.depth DESC) AS rk
        FROM ch c JOIN nd p ON c.doc_id = p.doc_id AND p.depth < c.child_depth AND p.w = substr(c.path, 1, p.depth)),
lk AS (SELECT a.doc_id, a.node_id, b.node_id AS suffix_link FROM nd a JOIN nd b ON a.doc_id = b.doc_id AND a.depth > 0 AND b.w = substr(a.w, 2)),
ed AS (SELECT anc.doc_id, CAST(row_number() OVER (PARTITION BY anc.doc_id ORDER BY path) AS INTEGER) AS ord, parent, CAST(parent_depth AS INTEGER) AS parent_depth, CAST(child AS INTEGER) AS child,
              CAST(child_depth AS INTEGER) AS child_depth, replace(substr(path, parent_depth + 1), chr(1114111), '$') AS label, CAST(coalesce(suffix_link, 0) AS INTEGER) AS suffix_link, path, CAST(start AS INTEGER) AS start
       FROM anc LEFT JOIN lk ON lk.doc_id = anc.doc_id AND lk.node_id = anc.child WHERE rk = 1)
"""


PART = "SELECT p_partkey AS doc_id, p_name AS s FROM part"


# ---- sources -------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN length(text) > 0 THEN strlen(text) / CAST(length(text) AS DOUBLE) END AS bytes_per_char,
CAST((length(text) + 3) * 4 AS BIGINT) AS memory_bytes, CASE WHEN strlen(text) > 0 THEN (length(text) + 3) * 4 * 100.0::DOUBLE / strlen(text) END AS memory_percent FROM documents WHERE text IS NOT NULL""")
def text_stats(spark, sf_dir):
    return text.text_stats(docs(spark, sf_dir))


@query("SELECT doc_id, CAST(unnest(range(1, length(text) + 2)) AS INTEGER) AS i, CAST(length(text) + 2 - unnest(range(1, length(text) + 2)) AS INTEGER) AS suffix_len FROM documents WHERE text IS NOT NULL")
def suffixes(spark, sf_dir):
    return trees.suffixes(docs(spark, sf_dir))


@query("SELECT doc_id, CAST(-i AS INTEGER) AS node_id, CAST(n + 2 - i AS INTEGER) AS depth FROM (SELECT doc_id, length(text) AS n, unnest(range(1, length(text) + 2)) AS i FROM documents WHERE text IS NOT NULL)")
def leaves(spark, sf_dir):
    return trees.leaves(docs(spark, sf_dir))


@query("""SELECT doc_id, CAST(b AS INTEGER) AS block_no, substr(text, b * 1000 + 1, 1000) AS chunk, length(substr(text, b * 1000 + 1, 1000)) < 1000 AS is_partial
FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS b FROM documents WHERE length(text) > 0)""")
def window_blocks(spark, sf_dir):
    return blocks.blocks(docs(spark, sf_dir), 1000)


SPECS = """SELECT l_orderkey * 8 + l_linenumber AS spec_id, l_orderkey % 5 AS block, l_partkey % 4 AS active, l_suppkey % 6 AS total, CASE WHEN l_orderkey % 2 = 0 THEN 'B' ELSE 'F' END AS method FROM lineitem"""


@query(f"""WITH s AS ({SPECS}), r AS (SELECT spec_id, method, CASE WHEN block = 0 THEN 8388608 ELSE block END AS block, CASE WHEN active = 0 THEN 1 ELSE active END AS active, total AS given FROM s),
q AS (SELECT *, CASE WHEN given <> 0 THEN given WHEN method = 'B' THEN 2 * active ELSE active + 2 END AS wanted, CASE WHEN method = 'B' THEN 2 * active ELSE active + 1 END AS least_total FROM r)
SELECT spec_id, CAST(block AS BIGINT) AS block, CAST(active AS BIGINT) AS active, CAST(greatest(wanted, least_total) AS BIGINT) AS total, method, wanted < least_total AS adjusted, CAST(block * active AS BIGINT) AS max_active,
CAST(block * greatest(wanted, least_total) AS BIGINT) AS max_total FROM q""")
def window_spec_resolve(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    specs = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("spec_id"), (F.col("l_orderkey") % 5).alias("block"), (F.col("l_partkey") % 4).alias("active"), (F.col("l_suppkey") % 6).alias("total"), F.when(F.col("l_orderkey") % 2 == 0, "B").otherwise("F").alias("method"))
    return blocks.resolve(specs)


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def transcode_round_trip(spark, sf_dir):
    """UTF-16 bytes and back, by a charset of the JVM and one of Python's."""
    d = docs(spark, sf_dir)
    utf16 = d.select("doc_id", F.encode("text", "UTF-16BE").alias("content"))
    return text.transcode(text.encode_text(text.transcode(utf16, "UTF-16BE"), "utf-8-sig").drop("text"), "utf-8-sig")


# ---- suffix arrays and trees ---------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT item_id AS doc_id, text AS s FROM benchmark WHERE text IS NOT NULL), x AS (SELECT doc_id, i, substr(s, i) || chr(1114111) AS sx FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM t)),
o AS (SELECT doc_id, i, sx, row_number() OVER w AS rank, lag(sx) OVER w AS before FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY sx))
SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(i AS INTEGER) AS i, CAST(CASE WHEN before IS NULL THEN 0 ELSE {LCP.format(a='sx', b='before')} END AS INTEGER) AS lcp FROM o""")
def suffix_array(spark, sf_dir):
    return trees.suffix_array(items(spark, sf_dir))


@query()
def documents_suffix_array(spark, sf_dir):
    return trees.suffix_array(docs(spark, sf_dir))


@query("""WITH a AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS edge FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey, o_orderstatus), b AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) * (o_custkey % 3) AS edge FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey, o_orderstatus)
SELECT * FROM (SELECT o_custkey, o_orderstatus, CASE WHEN b.edge IS NOT NULL THEN b.edge ELSE a.edge END AS edge FROM a FULL JOIN b USING (o_custkey, o_orderstatus)) WHERE edge <> 0""")
def record_upsert(spark, sf_dir):
    """Insert, overwrite and remove of keyed records; 0 is vacant."""
    o, key = spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey", "o_orderstatus"]
    records = o.where("o_orderkey % 2 = 0").groupBy(*key).agg(F.max("o_orderkey").alias("edge"))
    changes = o.where("o_orderkey % 2 = 1").groupBy(*key).agg((F.min("o_orderkey") * (F.col("o_custkey") % 3)).alias("edge"))
    return navigate.upsert(records, changes, key, "edge", vacant=0)


@query("SELECT o_orderkey, CAST('0x' || md5('7:' || o_orderkey)[1:15] AS BIGINT) % (o_orderkey + 1) AS r FROM orders")
def random_numbers(spark, sf_dir):
    """Seeded random numbers under each order's key + 1."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", numeric.random_below(F.col("o_orderkey"), F.col("o_orderkey") + 1, 7).alias("r"))


@query(tree() + "SELECT nd.doc_id, node_id, CAST(depth AS INTEGER) AS depth, CAST(head_position AS INTEGER) AS head_position, CAST(leftmost AS INTEGER) AS leftmost, CAST(n_children AS INTEGER) AS n_children FROM nd")
def branching_nodes(spark, sf_dir):
    return trees.nodes(items(spark, sf_dir)).drop("suffix_link", "parent")


@query()
def documents_branching_nodes(spark, sf_dir):
    return trees.nodes(docs(spark, sf_dir))


@query(tree() + "SELECT doc_id, CAST(node_id AS INTEGER) AS node_id, CAST(suffix_link AS INTEGER) AS suffix_link FROM lk")
def suffix_links(spark, sf_dir):
    return trees.nodes(items(spark, sf_dir)).where("depth > 0").select("doc_id", "node_id", "suffix_link")


@query(tree(PART) + "SELECT doc_id, ord, parent_depth, child_depth, CASE WHEN child < 0 THEN child ELSE 0 END AS leaf, label FROM ed")
def edges_simple(spark, sf_dir):
    e = trees.edges(names(spark, sf_dir))
    return e.select("doc_id", "ord", "parent_depth", "child_depth", F.when(F.col("child") < 0, F.col("child")).otherwise(0).alias("leaf"), "label")


EDGE_COLUMNS = ["doc_id", "ord", "parent", "parent_depth", "child", "child_depth", "label", "suffix_link"]


@query(tree() + f"SELECT {', '.join(EDGE_COLUMNS)} FROM ed")
def edges_detailed(spark, sf_dir):
    return trees.edges(items(spark, sf_dir)).select(*EDGE_COLUMNS)


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY substr(text, i) || chr(1114111)) AS BIGINT) AS rank, CAST(i AS BIGINT) AS i FROM (SELECT item_id AS doc_id, text, unnest(range(1, length(text) + 2)) AS i FROM benchmark)")
def large_suffix_array(spark, sf_dir):
    """The suffixes of each text, sorted across tasks in slices of 500 places."""
    return large.Index(large.pieces(items(spark, sf_dir), 100), span=500, rows=500).suffix_array().select("doc_id", "rank", "i")


@query(tree() + "SELECT doc_id, CAST(ord AS BIGINT) AS ord, parent, CAST(parent_depth AS BIGINT) AS parent_depth, CAST(child AS BIGINT) AS child, CAST(child_depth AS BIGINT) AS child_depth, suffix_link, CAST(start AS BIGINT) AS start FROM ed")
def large_edges(spark, sf_dir):
    """The edges of each text, built across tasks in slices of 500 places."""
    return large.Index(large.pieces(items(spark, sf_dir), 100), span=500, rows=500).edges().drop("label_len")


@query()
def documents_edges(spark, sf_dir):
    return trees.edges(docs(spark, sf_dir), labels=False, packed=True)


@query(tree() + "SELECT doc_id, child AS node_id, parent FROM ed")
def parent_pointers(spark, sf_dir):
    return navigate.parents(trees.edges(items(spark, sf_dir)))


# ---- navigation ----------------------------------------------------------------------------------------------------


@query(tree() + "SELECT doc_id, parent, arg_min(child, ord) AS first_child, count(*) AS n_children FROM ed GROUP BY doc_id, parent")
def first_child(spark, sf_dir):
    return navigate.first_children(trees.edges(items(spark, sf_dir)))


@query(tree() + "SELECT doc_id, parent, child, substr(label, 1, 1) AS letter, lag(child) OVER w AS prev_child, lead(child) OVER w AS next_child FROM ed WINDOW w AS (PARTITION BY doc_id, parent ORDER BY ord)")
def sibling_next_prev(spark, sf_dir):
    return navigate.siblings(trees.edges(items(spark, sf_dir)))


@query(tree() + """SELECT nd.doc_id, nd.node_id AS parent, x.letter, ed.child, ed.child_depth FROM nd CROSS JOIN (SELECT unnest(['a', 'e', ' ', 'q']) AS letter) x
LEFT JOIN ed ON ed.doc_id = nd.doc_id AND ed.parent = nd.node_id AND substr(ed.label, 1, 1) = x.letter AND NOT (x.letter = '$')""")
def child_by_letter(spark, sf_dir):
    found = trees.edges(items(spark, sf_dir))
    letters = F.explode(F.array(*map(F.lit, ["a", "e", " ", "q"])))
    probes = trees.nodes(items(spark, sf_dir)).select("doc_id", F.col("node_id").alias("parent"), letters.alias("letter"))
    return navigate.child_by_letter(found, probes).select("doc_id", "parent", "letter", "child", "child_depth")


@query(tree() + f"""SELECT doc_id, pattern, CAST(coalesce(child, 0) AS INTEGER) AS child, CAST(CASE WHEN child IS NULL THEN 2 ELSE 0 END AS INTEGER) AS fast, CAST(matched AS INTEGER) AS matched,
CAST(CASE WHEN child IS NULL THEN NULL WHEN matched = length(label) THEN 0 WHEN matched = length(pattern) THEN 2 WHEN child < 0 AND matched = length(label) - 1 THEN 1
 WHEN substr(label, matched + 1, 1) > substr(pattern, matched + 1, 1) THEN 1 ELSE -1 END AS INTEGER) AS slow, CAST(sign(child_depth - length(pattern)) AS INTEGER) AS depth FROM (
SELECT t.doc_id, x.pattern, ed.child, ed.child_depth, ed.label, CASE WHEN ed.child IS NULL THEN 0 ELSE {LCP.format(a='ed.label', b='x.pattern')} END AS matched
FROM t CROSS JOIN (SELECT unnest({PATTERNS}) AS pattern) x LEFT JOIN ed ON ed.doc_id = t.doc_id AND ed.parent = 1 AND substr(ed.label, 1, 1) = substr(x.pattern, 1, 1))""")
def scans(spark, sf_dir):
    """Fastscan, slowscan and depthscan of given patterns at each root."""
    return navigate.scans(trees.edges(items(spark, sf_dir)), PATTERNS)


@query(tree() + f"""SELECT ed.doc_id, x.pattern, CAST(ed.child AS INTEGER) AS child, CAST(CASE WHEN ed.child < 0 AND length(ed.label) = 1 THEN 1
 WHEN substr(ed.label, 1, 1) < substr(x.pattern, 1, 1) THEN -1 WHEN substr(ed.label, 1, 1) = substr(x.pattern, 1, 1) THEN 0 ELSE 1 END AS INTEGER) AS fast
FROM ed CROSS JOIN (SELECT unnest({PATTERNS}) AS pattern) x WHERE ed.parent = 1""")
def fastscans(spark, sf_dir):
    """The sign of the fastscan of every edge of each root."""
    return navigate.fastscans(trees.edges(items(spark, sf_dir)), PATTERNS)


@query(tree() + "SELECT doc_id, parent AS node, parent_depth AS node_depth, child, CAST(CASE WHEN parent_depth = 3 THEN 0 ELSE -1 END AS INTEGER) AS exact FROM ed WHERE parent_depth <= 3 AND child_depth > 3")
def locus_at_depth(spark, sf_dir):
    return navigate.locus(trees.edges(items(spark, sf_dir)), 3)


@query(tree() + """, chain AS (SELECT doc_id, child AS node, child AS x FROM ed UNION ALL SELECT doc_id, child, parent FROM anc WHERE parent <> 1)
SELECT c.doc_id, CAST(c.node AS INTEGER) AS node, arg_max(e.parent, e.parent_depth) AS parent, arg_max(e.child, e.parent_depth) AS child, CAST(CASE WHEN max(e.parent_depth) = 3 THEN 0 ELSE -1 END AS INTEGER) AS exact
FROM chain c JOIN ed e ON e.doc_id = c.doc_id AND e.child = c.x WHERE e.parent_depth <= 3 GROUP BY c.doc_id, c.node""")
def go_up(spark, sf_dir):
    """The climb from every node to depth 3."""
    return navigate.go_up_texts(items(spark, sf_dir), 3)


@query()
def documents_go_up(spark, sf_dir):
    return navigate.go_up_texts(docs(spark, sf_dir), 3)


@query(tree() + """, chain AS (SELECT doc_id, child AS node, child_depth // 2 AS depth, child AS x FROM ed UNION ALL SELECT a.doc_id, a.child, a.child_depth // 2, a.parent FROM anc a WHERE a.parent <> 1)
SELECT c.doc_id, CAST(c.node AS INTEGER) AS node, CAST(c.depth AS INTEGER) AS depth, arg_max(e.parent, e.parent_depth) AS parent, arg_max(e.child, e.parent_depth) AS child, CAST(CASE WHEN max(e.parent_depth) = c.depth THEN 0 ELSE -1 END AS INTEGER) AS exact
FROM chain c JOIN ed e ON e.doc_id = c.doc_id AND e.child = c.x WHERE e.parent_depth <= c.depth GROUP BY c.doc_id, c.node, c.depth""")
def go_up_each(spark, sf_dir):
    """The climb from every node to half its own depth, by jump pointers."""
    e = trees.edges(items(spark, sf_dir), labels=False)
    asks = e.select("doc_id", F.col("child").alias("node"), F.floor(F.col("child_depth") / 2).cast("int").alias("depth"))
    return navigate.go_up_each(e, asks).select("doc_id", "node", "depth", "parent", "child", "exact")


@query(tree() + """, asks AS (SELECT doc_id, child AS node, (parent_depth + child_depth) // 2 AS d, path FROM ed WHERE child_depth > parent_depth + 1)
SELECT a.doc_id, a.node, CAST(a.d AS INTEGER) AS depth, e.parent, e.child, CAST(CASE WHEN e.parent_depth = a.d - 1 THEN 0 ELSE -1 END AS INTEGER) AS exact
FROM asks a JOIN ed e ON e.doc_id = a.doc_id AND e.parent_depth <= a.d - 1 AND e.child_depth > a.d - 1 AND starts_with(substr(a.path, 2), e.path)""")
def place_links(spark, sf_dir):
    """The suffix link of the middle of every edge."""
    e = trees.edges(items(spark, sf_dir), labels=False)
    middle = F.floor((F.col("parent_depth") + F.col("child_depth")) / 2).cast("int")
    asks = e.where("child_depth > parent_depth + 1").select("doc_id", F.col("child").alias("node"), middle.alias("at"))
    return navigate.place_links(e, asks).select("doc_id", "node", F.col("at").alias("depth"), "parent", "child", "exact")


DOLLARS = "SELECT p_partkey AS doc_id, replace(p_name, ' ', '$') AS s FROM part"


@query(tree(DOLLARS) + """SELECT nd.doc_id, nd.node_id AS parent, x.letter, ed.child, ed.child_depth FROM nd CROSS JOIN (SELECT unnest(['a', '$']) AS letter) x
LEFT JOIN ed ON ed.doc_id = nd.doc_id AND ed.parent = nd.node_id AND substr(ed.path, ed.parent_depth + 1, 1) = x.letter""")
def child_by_dollar(spark, sf_dir):
    """Children by letter where the texts have "$" as a letter."""
    texts = names(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" "), F.lit("$")))
    probes = trees.nodes(texts).select("doc_id", F.col("node_id").alias("parent"), F.explode(F.array(F.lit("a"), F.lit("$"))).alias("letter"))
    return navigate.child_by_letter(trees.edges(texts), probes).select("doc_id", "parent", "letter", "child", "child_depth")


# ---- patterns ------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), g AS (SELECT item_id * 100000 + k AS pattern_id, array_to_string(w[k + 1:k + 5], ' ') AS p FROM (SELECT *, unnest(range(0, len(w) - 4)) AS k FROM w))
SELECT doc_id, pattern_id, CAST(len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(p)) = p)) AS BIGINT) AS n_occurrences, CAST(instr(text, p) AS INTEGER) AS leftmost
FROM documents JOIN g ON contains(text, p) WHERE p <> ''""")
def pattern_occurrences(spark, sf_dir):
    """Every five words of ``benchmark`` in every document: count and first place."""
    w = items(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w"))
    at = w.where(F.size("w") >= 5).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 5)).alias("k"))
    grams = at.select((F.col("doc_id") * 100000 + F.col("k")).alias("pattern_id"), F.array_join(F.slice("w", F.col("k") + 1, 5), " ").alias("pattern"))
    return search.occurrences(docs(spark, sf_dir), grams).select("doc_id", "pattern_id", "n_occurrences", "leftmost")


WALKS = ["the quick", "ation of", "z", "", "$5", "Überall", "and then the end of it", ". "]


@query(f"""WITH p AS (SELECT unnest({WALKS!r}) AS p, unnest(range({len(WALKS)})) AS pattern_id) SELECT doc_id, pattern_id,
CAST(coalesce(list_max(list_filter(range(1, length(p) + 1), lambda k: contains(text, substr(p, 1, k)))), 0) AS INTEGER) AS matched FROM documents, p WHERE text IS NOT NULL AND p <> ''""")
def pattern_walks(spark, sf_dir):
    """How far each of some patterns goes down every document's tree."""
    patterns = spark.createDataFrame(list(enumerate(WALKS)), "pattern_id long, pattern string")
    return search.walks(docs(spark, sf_dir), patterns).select("doc_id", "pattern_id", "matched")


@query(tree() + "SELECT doc_id, parent, CAST(row_number() OVER w AS INTEGER) AS nth, substr(label, 1, 1) AS letter, child < 0 AS is_leaf, lead(child) OVER w IS NULL AS is_last FROM ed WINDOW w AS (PARTITION BY doc_id, parent ORDER BY ord)")
def node_groups(spark, sf_dir):
    return navigate.node_groups(trees.edges(items(spark, sf_dir)))


@query(tree() + "SELECT doc_id, parent, CAST(min(CASE WHEN child > 0 THEN child_depth - parent_depth END) AS INTEGER) AS children_lcp FROM ed GROUP BY doc_id, parent")
def children_lcp(spark, sf_dir):
    return navigate.children_lcp(trees.edges(items(spark, sf_dir)))


@query(tree() + "SELECT doc_id, ord, parent, CAST(CASE WHEN child < 0 THEN 1 ELSE 2 END AS INTEGER) AS cells, start + parent_depth AS text_index, lead(child) OVER (PARTITION BY doc_id, parent ORDER BY ord) IS NULL AS is_last FROM ed")
def linear_array(spark, sf_dir):
    return traverse.linear_array(trees.edges(items(spark, sf_dir)))


# ---- prefix partitions ---------------------------------------------------------------------------------------------


def partition_sql(p: int) -> str:
    return f"""WITH t AS (SELECT item_id AS doc_id, text AS s FROM benchmark WHERE text IS NOT NULL), x AS (SELECT doc_id, i, substr(s, i) || chr(1114111) AS sx FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM t)),
g AS (SELECT doc_id, substr(sx, 1, {p}) AS prefix, count(*) AS cnt, min(i) AS text_offset, min(sx) AS lo, max(sx) AS hi FROM x GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, CAST(1 + sum(cnt) OVER w - cnt AS BIGINT) AS begin_offset, CAST(1 + sum(cnt) OVER w AS BIGINT) AS end_offset,
CAST(CASE WHEN cnt = 1 THEN length(lo) ELSE {LCP.format(a='lo', b='hi')} END AS INTEGER) AS lcp_size, CAST(text_offset AS INTEGER) AS text_offset FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY prefix ROWS UNBOUNDED PRECEDING)"""


@query(partition_sql(1))
def prefix_partitions_p1(spark, sf_dir):
    return partitions.partitions(items(spark, sf_dir), 1)


@query(partition_sql(2))
def prefix_partitions_p2(spark, sf_dir):
    return partitions.partitions(items(spark, sf_dir), 2)


@query(partition_sql(3))
def prefix_partitions_p3(spark, sf_dir):
    return partitions.partitions(items(spark, sf_dir), 3)


@query("""WITH x AS (SELECT doc_id, i, CASE WHEN i < length(s) THEN substr(s, i, 2) ELSE substr(s, i) || chr(1114111) END AS prefix FROM (SELECT doc_id, text AS s, unnest(range(1, length(text) + 2)) AS i FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, prefix, count(*) AS cnt, min(i) AS text_offset FROM x GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, CAST(1 + sum(cnt) OVER w - cnt AS BIGINT) AS begin_offset, CAST(1 + sum(cnt) OVER w AS BIGINT) AS end_offset, CAST(text_offset AS INTEGER) AS text_offset
FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY prefix ROWS UNBOUNDED PRECEDING)""")
def documents_prefix_partitions(spark, sf_dir):
    return partitions.partitions(docs(spark, sf_dir), 2).drop("lcp_size")


@query()
def documents_partition_lcp(spark, sf_dir):
    """The same with the common length of each partition, which SQL has only from whole suffixes."""
    return partitions.partitions(docs(spark, sf_dir), 2)


@query(f"SELECT doc_id, min(text_offset) AS least_offset, max(idx) + 1 AS n_partitions FROM ({partition_sql(2)}) GROUP BY doc_id")
def partition_min_offset(spark, sf_dir):
    return partitions.partitions(items(spark, sf_dir), 2).groupBy("doc_id").agg(F.min("text_offset").alias("least_offset"), (F.max("idx") + 1).alias("n_partitions"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS i FROM (SELECT doc_id, text, unnest(range(1, length(text) + 2)) AS i FROM documents WHERE text IS NOT NULL) WHERE substr(text, i, 2) = 'th'")
def partition_select(spark, sf_dir):
    return partitions.select_partition(docs(spark, sf_dir), "th")


@query("""SELECT l_orderkey, l_linenumber, n, CAST(CASE WHEN n + 1 <= 1048576 THEN 0 ELSE 1 + CAST((n + 1) >> 25 > 0 AS INTEGER) + CAST((n + 1) >> 30 > 0 AS INTEGER) + CAST((n + 1) >> 35 > 0 AS INTEGER) + CAST((n + 1) >> 40 > 0 AS INTEGER)
+ CAST((n + 1) >> 45 > 0 AS INTEGER) + CAST((n + 1) >> 50 > 0 AS INTEGER) + CAST((n + 1) >> 55 > 0 AS INTEGER) + CAST((n + 1) >> 60 > 0 AS INTEGER) END AS INTEGER) AS prefix_length FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * l_orderkey * 1000 AS BIGINT) AS n FROM lineitem)""")
def auto_prefix_length(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = (F.col("l_partkey") * F.col("l_orderkey") * 1000).cast("long")
    return li.select("l_orderkey", "l_linenumber", n.alias("n"), partitions.auto_prefix_length(n).alias("prefix_length"))


# ---- rendering -----------------------------------------------------------------------------------------------------


def log_sql(detailed: bool) -> str:
    pad = lambda x, w: f"(CASE WHEN {x} < 0 THEN '-' || lpad(CAST(-{x} AS VARCHAR), CAST(greatest({w} - 1, length(CAST(-{x} AS VARCHAR))) AS INTEGER), '0') ELSE lpad(CAST({x} AS VARCHAR), CAST(greatest({w}, length(CAST({x} AS VARCHAR))) AS INTEGER), '0') END)"
    title = "Suffix tree traversal" if detailed else "Simple suffix tree traversal"
    parent = pad("parent", "wb") if detailed else "'?'"
    child = f"CASE WHEN child < 0 THEN {pad('child', 'wl')} ELSE {pad('child', 'wb') if detailed else chr(39) + '?' + chr(39)} END"
    link = f"CASE WHEN suffix_link <> 0 THEN '{{' || {pad('suffix_link', 'wb')} || '}}' ELSE '' END" if detailed else "''"
    return tree(PART if not detailed else "SELECT item_id AS doc_id, text AS s FROM benchmark") + f""",
w AS (SELECT doc_id, length(CAST(greatest(max(child), 1) AS VARCHAR)) AS wb, length(CAST(-min(child) AS VARCHAR)) AS wl, max(ord) AS last FROM ed GROUP BY doc_id)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, 'P(' || {parent} || ')[' || parent_depth || ']--"' || CASE WHEN length(label) < 33 THEN label ELSE substr(label, 1, 15) || '...' || right(label, 15) END || '"(' || (child_depth - parent_depth) || ')-->C('
 || {child} || ')[' || child_depth || ']' || {link} AS line FROM ed JOIN w USING (doc_id)
UNION ALL SELECT doc_id, 0, '{title} BEGIN' FROM w UNION ALL SELECT doc_id, CAST(last + 1 AS BIGINT), '{title} END' FROM w"""


@query(log_sql(False))
def traversal_log_simple(spark, sf_dir):
    return traverse.log(trees.edges(names(spark, sf_dir)), detailed=False)


@query(log_sql(True))
def traversal_log_detailed(spark, sf_dir):
    return traverse.log(trees.edges(items(spark, sf_dir)), detailed=True)


@query("""SELECT doc_id, CAST(i AS INTEGER) AS i, i || ': ' || CASE WHEN n + 2 - i < 33 THEN substr(s, i) ELSE substr(s, i, 15) || '...' || right(s, 15) END || ' (' || (n + 2 - i) || ')' AS line
FROM (SELECT item_id AS doc_id, text || '$' AS s, length(text) AS n, unnest(range(1, length(text) + 2)) AS i FROM benchmark WHERE text IS NOT NULL)""")
def suffix_print(spark, sf_dir):
    return traverse.suffix_lines(items(spark, sf_dir))


# ---- statistics ----------------------------------------------------------------------------------------------------


def stats_sql(layout: str) -> str:
    leaf, edge, branch = memory.RECORDS[layout]
    la = "4 * (n + 1 + 2 * (bn - 1))" if layout == "LA" else "0"
    return tree() + f""", c AS (SELECT t.doc_id, length(t.s) AS n, (SELECT count(*) FROM nd WHERE nd.doc_id = t.doc_id) AS bn FROM t),
u AS (SELECT *, CAST((n + 1) * {leaf} + (bn + n) * {edge} + bn * {branch} + {la} AS BIGINT) AS used FROM c)
SELECT doc_id, '{layout}' AS layout, CAST(n AS BIGINT) AS length, CAST(bn + n AS BIGINT) AS edges, CAST(bn AS BIGINT) AS branching_nodes, CAST(n + 1 + 2 * (bn - 1) AS BIGINT) AS la_cells, CAST(n + 2 * (bn - 1) AS BIGINT) AS la_records,
used AS used_bytes, CASE WHEN n > 0 THEN used / CAST(n AS DOUBLE) END AS bytes_per_char FROM u"""


def _stats(layout: str):
    def run(spark, sf_dir):
        return memory.tree_stats(trees.tree_counts(items(spark, sf_dir)), layout)

    run.__name__ = f"tree_stats_{layout.lower()}"
    return run


for _layout in memory.RECORDS:
    query(stats_sql(_layout))(_stats(_layout))


def allocation_sql(layout: str) -> str:
    leaf, _, branch = memory.RECORDS[layout]
    return f"""WITH RECURSIVE u AS (SELECT doc_id, length AS n, branching_nodes AS bn, used_bytes, CASE WHEN length > 0 THEN CAST(1 AS BIGINT) << CAST(floor(log2(length)) AS INTEGER) ELSE 0 END AS least FROM ({stats_sql(layout)})),
g AS (SELECT doc_id, n, bn, least AS size, least // 2 AS step FROM u UNION ALL SELECT doc_id, n, bn, least(size + step, n), CASE WHEN step < 256 THEN 128 ELSE step // 2 END FROM g WHERE size <= bn AND size < n),
m AS (SELECT doc_id, max(size) AS size FROM g GROUP BY doc_id), a AS (SELECT *, CAST((n + 2) * {leaf} + (size + 1) * {branch} AS BIGINT) AS allocated FROM u JOIN m USING (doc_id))
SELECT doc_id, '{layout}' AS layout, CAST(size AS BIGINT) AS node_records, allocated AS allocated_bytes, used_bytes, CASE WHEN n > 0 THEN allocated / CAST(n AS DOUBLE) END AS allocated_per_char,
CASE WHEN size > 0 THEN 100.0::DOUBLE * bn / size END AS node_load_percent, 100.0::DOUBLE * used_bytes / allocated AS memory_load_percent FROM a"""


@query(allocation_sql("SL"))
def allocation_sl(spark, sf_dir):
    return memory.allocation(trees.tree_counts(items(spark, sf_dir)), "SL")


@query(allocation_sql("SL_BP"))
def allocation_sl_bp(spark, sf_dir):
    return memory.allocation(trees.tree_counts(items(spark, sf_dir)), "SL_BP")


@query()
def documents_tree_stats(spark, sf_dir):
    """The headline: counts of the whole suffix tree of every whole document."""
    return memory.tree_stats(trees.tree_counts(docs(spark, sf_dir)), "SL")


@query("""SELECT o_orderkey, n, CAST(sum(n) OVER w AS BIGINT) AS in_use, CAST(max(s) OVER w AS BIGINT) AS high_water FROM (
SELECT o_orderkey, o_custkey, n, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 7 - 3 AS BIGINT) AS n FROM orders))
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def memory_high_water(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7 - 3).cast("long").alias("n"))
    return memory.high_water(o, "o_custkey", "o_orderkey", "n").drop("o_custkey")


# ---- scalar functions ----------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * l_orderkey * (l_linenumber * 97 + 1) AS BIGINT) AS size FROM lineitem),
k AS (SELECT *, CASE WHEN size >= 1152921504606846976 THEN 6 WHEN size >= 1125899906842624 THEN 5 WHEN size >= 1099511627776 THEN 4 WHEN size >= 1073741824 THEN 3 WHEN size >= 1048576 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS o FROM x),
f AS (SELECT *, CASE WHEN o = 0 THEN 0 ELSE CAST(floor(0.5 + CAST(size & ((CAST(1 AS BIGINT) << (10 * o)) - 1) AS DOUBLE) / CAST(CAST(1 AS BIGINT) << (10 * greatest(o - 1, 0)) AS DOUBLE) * 0.9765625) AS BIGINT) END AS part FROM k)
SELECT l_orderkey, l_linenumber, size, CASE WHEN o = 0 THEN size || ' B' ELSE ((size >> (10 * o)) + CASE WHEN part = 1000 THEN 1 ELSE 0 END) || '.' || lpad(CAST(part % 1000 AS VARCHAR), 3, '0') || ' ' || substr('KMGTPE', o, 1) || 'iB' END AS human FROM f""")
def human_size(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = (F.col("l_partkey") * F.col("l_orderkey") * (F.col("l_linenumber") * 97 + 1)).cast("long")
    return li.select("l_orderkey", "l_linenumber", size.alias("size"), numeric.human_size(size).alias("human"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 997 + l_orderkey * 31 AS BIGINT) AS ms FROM lineitem),
y AS (SELECT *, ms // 1000 % 60 AS s, ms // 60000 % 60 AS m, ms // 3600000 AS h FROM x)
SELECT l_orderkey, l_linenumber, ms, CASE WHEN h <> 0 THEN h || ' hours, ' ELSE '' END || CASE WHEN m <> 0 THEN m || ' minutes, ' ELSE '' END ||
CASE WHEN s <> 0 THEN s || '.' || CASE WHEN ms % 1000 >= 995 THEN '100' ELSE lpad(CAST((ms % 1000 + 5) // 10 AS VARCHAR), 2, '0') END || ' seconds (' ELSE ms % 1000 || ' milliseconds (' END || ms || ' ms)' AS human FROM y""")
def human_time(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ms = (F.col("l_partkey") * 997 + F.col("l_orderkey") * 31).cast("long")
    return li.select("l_orderkey", "l_linenumber", ms.alias("ms"), numeric.human_time(ms).alias("human"))


@query("SELECT doc_id, CAST(length(CAST(length(text) + 1 AS VARCHAR)) AS INTEGER) AS leaf_digits FROM documents WHERE text IS NOT NULL")
def digit_width(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", numeric.digits(F.length("text") + 1).alias("leaf_digits"))


@query("SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) * 123456789012345) * (CAST(o_custkey AS HUGEINT) + 987654321) % 1000000007 AS BIGINT) AS product FROM orders")
def mod_mul(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = (F.col("o_orderkey").cast("decimal(38,0)") * F.lit(123456789012345)).cast("decimal(38,0)") % F.lit(1000000007)
    return o.select("o_orderkey", numeric.mul_mod(a, F.col("o_custkey") + 987654321, F.lit(1000000007)).cast("long").alias("product"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey, CAST(o_custkey % 1000 + 2 AS BIGINT) AS base, CAST(o_orderkey % 64 AS BIGINT) AS e, CAST(1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS k FROM orders
UNION ALL SELECT o_orderkey, base, e, r * base % 1000003, k + 1 FROM p WHERE k < e) SELECT o_orderkey, r AS power FROM p WHERE k = e""")
def mod_pow(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", numeric.pow_mod(F.col("o_custkey") % 1000 + 2, F.col("o_orderkey") % 64, F.lit(1000003)).cast("long").alias("power"))


@query("""SELECT p_partkey, n, n > 1 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 200)) AS d) WHERE d * d <= n AND n % d = 0) AS is_prime FROM (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS n FROM part)""")
def is_prime(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.col("p_partkey").cast("long").alias("n"), numeric.is_prime(F.col("p_partkey").cast("long")).alias("is_prime"))


@query("""SELECT p_partkey, p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 200)) AS d) WHERE d * d <= p_partkey AND p_partkey % d = 0) AS passes FROM part""")
def fermat_test(spark, sf_dir):
    """The Fermat test: up to 252,600 no composite passes all its bases, whose own multiples never do."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", numeric.is_fermat_prime(F.col("p_partkey").cast("long")).alias("passes"))


@query("""WITH q AS (SELECT n FROM (SELECT unnest(range(2, 30000)) AS n) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 175)) AS d) WHERE d * d <= n AND n % d = 0))
SELECT p_partkey, CAST((SELECT min(q.n) FROM q WHERE q.n > p.p_partkey) AS BIGINT) AS next_prime FROM part p""")
def next_prime(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", numeric.next_prime(F.col("p_partkey").cast("long")).alias("next_prime"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, xor(l_orderkey, CAST(ascii(l_returnflag) AS BIGINT) << 32) AS key FROM lineitem)
SELECT l_orderkey, l_linenumber, key % 1009 AS h1, key % 1007 + 1 AS h2 FROM k""")
def hash_primary_secondary(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    node, letter = F.col("l_orderkey"), F.ascii("l_returnflag")
    return li.select("l_orderkey", "l_linenumber", numeric.primary_hash(node, letter, 1009).alias("h1"), numeric.secondary_hash(node, letter, 1009).alias("h2"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, CAST(xor(l_orderkey, CAST(ascii(l_returnflag) AS BIGINT) << 32) AS HUGEINT) AS key FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST((3141592653 * key + 271828182) % 18446744073709551616 % 4294967291 % 1013 + 500 AS BIGINT) AS h FROM k""")
def hash_cuckoo(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", numeric.cuckoo_hash(F.col("l_orderkey"), F.ascii("l_returnflag"), 3141592653, 271828182, 1013, 500).alias("h"))


@query("""WITH x AS (SELECT doc_id, CAST(2 * length(text) + 2 AS BIGINT) AS wanted FROM documents WHERE text IS NOT NULL), top AS (SELECT max(wanted) + 500 AS m FROM x),
q AS (SELECT n FROM (SELECT unnest(range(2, (SELECT m FROM top))) AS n) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, (SELECT CAST(sqrt(m) AS BIGINT) + 1 FROM top))) AS d) WHERE d * d <= n AND n % d = 0)),
p AS (SELECT x.doc_id, min(q.n) AS cuckoo_first_size FROM x JOIN q ON q.n > greatest(1, wanted // 8) AND q.n <= greatest(1, wanted // 8) + 500 GROUP BY x.doc_id),
r AS (SELECT x.doc_id, min(q.n) AS double_size FROM x JOIN q ON q.n > wanted AND q.n <= wanted + 500 GROUP BY x.doc_id)
SELECT doc_id, cuckoo_first_size, double_size, double_size - 2 AS second_hash_size FROM p JOIN r USING (doc_id)""")
def hash_settings(spark, sf_dir):
    """Cuckoo table sizes for the number of edges of each document's tree."""
    d = docs(spark, sf_dir).select("doc_id", (2 * F.length("text") + 2).alias("wanted"))
    first = numeric.next_prime(F.greatest(F.lit(1), F.floor(F.col("wanted") / 8)).cast("long"))
    double = numeric.next_prime(F.col("wanted").cast("long"))
    return d.select("doc_id", first.alias("cuckoo_first_size"), double.alias("double_size"), (double - 2).alias("second_hash_size"))


# ---- sliding windows -----------------------------------------------------------------------------------------------


def snapshot_sql(source: str = "SELECT item_id AS doc_id, text AS s FROM benchmark", block: int = BLOCK, size: int = SIZE) -> str:
    return f"""sn AS (SELECT doc_id, k AS window_no, k * {block} + 1 AS win_begin, least(k * {block} + {size}, n) AS win_end, n >= {size} AS is_full, substr(s, k * {block} + 1, least({size}, n - k * {block})) AS buffer
FROM (SELECT doc_id, s, length(s) AS n, unnest(range(0, CAST(greatest(0, ceil((length(s) - {size}) / CAST({block} AS DOUBLE))) AS BIGINT) + 1)) AS k FROM ({source}) WHERE length(s) > 0))"""


@query("""WITH RECURSIVE x AS (SELECT DISTINCT CAST(l_orderkey % 5000 + 16 AS BIGINT) AS wanted FROM lineitem),
q AS (SELECT CAST(n AS BIGINT) AS n FROM (SELECT unnest(range(2, 2000)) AS n) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 46)) AS d) WHERE d * d <= n AND n % d = 0)),
f AS (SELECT n, lead(n) OVER (ORDER BY n) AS following FROM q),
t AS (SELECT x.wanted, 0 AS i, min(q.n) AS size FROM x JOIN q ON q.n > greatest(1, wanted // 8) GROUP BY x.wanted
 UNION ALL SELECT t.wanted, t.i + 1, f.following FROM t JOIN f ON f.n = t.size WHERE t.i < 7)
SELECT wanted, CAST(i AS INTEGER) AS i, size, CAST(sum(size) OVER (PARTITION BY wanted ORDER BY i) - size AS BIGINT) AS "offset" FROM t""")
def cuckoo_tables(spark, sf_dir):
    """Size and offset of all eight cuckoo tables for some requested sizes."""
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 5000 + 16).cast("long").alias("wanted")).distinct()
    tables = wanted.withColumn("size0", numeric.next_prime(F.greatest(F.lit(1), F.floor(F.col("wanted") / 8)).cast("long")))
    for i in range(1, 8):
        tables = tables.withColumn(f"size{i}", numeric.next_prime(F.col(f"size{i - 1}")))
    before = lambda i: sum((F.col(f"size{k}") for k in range(i)), F.lit(0).cast("long"))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"size{i}").alias("size"), before(i).alias("offset")) for i in range(8)))
    return tables.select("wanted", F.inline(rows))


@query(f"WITH {snapshot_sql('SELECT doc_id, text AS s FROM documents', 500, 1000)} SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, CAST(win_begin AS INTEGER) AS win_begin, CAST(win_end AS INTEGER) AS win_end, CAST(win_end - win_begin + 1 AS INTEGER) AS win_len, is_full, buffer FROM sn")
def window_snapshots(spark, sf_dir):
    return windows.snapshots(docs(spark, sf_dir), 500, 2)


WINDOW_EDGES = f"""WITH {snapshot_sql()},
ws AS (SELECT doc_id, window_no, win_begin, buffer, length(buffer) AS n, unnest(range(1, length(buffer) + 1)) AS i FROM sn),
sub AS (SELECT doc_id, window_no, n, i, substr(buffer, i, l) AS w, CASE WHEN i + l <= n THEN substr(buffer, i + l, 1) END AS nc FROM (SELECT *, unnest(range(0, n + 2 - i)) AS l FROM ws)),
g AS (SELECT doc_id, window_no, w, count(*) AS c, count(DISTINCT nc) AS r FROM sub GROUP BY ALL),
nd AS (SELECT doc_id, window_no, w, length(w) AS depth FROM g WHERE w = '' OR r >= 2),
lf AS (SELECT ws.doc_id, ws.window_no, substr(buffer, i) AS path, win_begin + i - 1 AS leaf_start FROM ws JOIN g ON g.doc_id = ws.doc_id AND g.window_no = ws.window_no AND g.w = substr(buffer, i) AND g.c = 1),
ch AS (SELECT doc_id, window_no, w AS path, 0 AS leaf_start FROM nd WHERE w <> '' UNION ALL SELECT * FROM lf),
we AS (SELECT c.doc_id, CAST(c.window_no AS INTEGER) AS window_no, c.path, CAST(max(p.depth) AS INTEGER) AS parent_depth, CAST(length(c.path) AS INTEGER) AS child_depth, substr(c.path, max(p.depth) + 1) AS label, CAST(c.leaf_start AS INTEGER) AS leaf_start
       FROM ch c JOIN nd p ON p.doc_id = c.doc_id AND p.window_no = c.window_no AND p.depth < length(c.path) AND p.w = substr(c.path, 1, p.depth) GROUP BY c.doc_id, c.window_no, c.path, c.leaf_start)
"""


@query(WINDOW_EDGES + "SELECT * FROM we")
def window_edges(spark, sf_dir):
    return windows.window_edges(windows.snapshots(items(spark, sf_dir), BLOCK, ACTIVE))


@query(WINDOW_EDGES + "SELECT doc_id, window_no, path, leaf_start FROM we a WHERE window_no < (SELECT max(window_no) FROM we b WHERE b.doc_id = a.doc_id) AND NOT EXISTS (SELECT 1 FROM we x WHERE x.doc_id = a.doc_id AND x.window_no = a.window_no + 1 AND x.path = a.path AND x.leaf_start = a.leaf_start)")
def window_eviction(spark, sf_dir):
    return windows.evicted(windows.window_edges(windows.snapshots(items(spark, sf_dir), BLOCK, ACTIVE)))


WINDOW_STATS = f"""WITH t AS (SELECT item_id AS doc_id, text AS s FROM benchmark WHERE length(text) > 0), wi AS (SELECT doc_id, length(s) AS n, b, substr(s, b, {SIZE}) AS x FROM (SELECT *, unnest(range(1, greatest(length(s) - {SIZE}, 0) + 2)) AS b FROM t)),
sub AS (SELECT doc_id, n, b, substr(x, i, l) AS w, CASE WHEN i + l <= length(x) THEN substr(x, i + l, 1) END AS nc FROM (SELECT *, unnest(range(1, length(x) + 2 - i)) AS l FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM wi))),
g AS (SELECT doc_id, n, b, w, count(*) AS c, count(DISTINCT nc) AS r, max(CASE WHEN nc IS NULL THEN 1 ELSE 0 END) AS ends FROM sub GROUP BY ALL),
st AS (SELECT doc_id, n, b, 1 + sum(CASE WHEN r >= 2 THEN 1 ELSE 0 END) AS bn, sum(CASE WHEN c = 1 AND ends = 1 THEN 1 ELSE 0 END) AS leaves FROM g GROUP BY ALL),
ws AS (SELECT doc_id, CAST(n AS BIGINT) AS n, count(*) AS observations, CAST(min(bn) AS BIGINT) AS min_bn, CAST(arg_min(b, bn * 100000 + b) AS BIGINT) AS min_bn_at, CAST(sum(bn) AS DOUBLE) / count(*) AS avg_bn, CAST(max(bn) AS BIGINT) AS max_bn, CAST(arg_max(b, bn * 100000 - b) AS BIGINT) AS max_bn_at,
CAST(min(bn - 1 + leaves) AS BIGINT) AS min_edges, CAST(arg_min(b, (bn - 1 + leaves) * 100000 + b) AS BIGINT) AS min_edges_at, CAST(sum(bn - 1 + leaves) AS DOUBLE) / count(*) AS avg_edges, CAST(max(bn - 1 + leaves) AS BIGINT) AS max_edges, CAST(arg_max(b, (bn - 1 + leaves) * 100000 - b) AS BIGINT) AS max_edges_at
FROM st GROUP BY doc_id, n)
"""


@query(WINDOW_STATS + "SELECT * FROM ws")
def window_stats(spark, sf_dir):
    return windows.window_stats(items(spark, sf_dir), SIZE)


SWEPT = f"""WITH t AS (SELECT doc_id, text, length(text) AS n, least({SIZE}, length(text)) AS w FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, n, w, a, substr(text, a + 1, 200 + {SIZE}) AS chunk FROM (SELECT *, unnest(range(0, n, 200)) AS a FROM t)),
o AS (SELECT doc_id, n, w, a + j AS o, substr(chunk, j + 1, {SIZE}) AS x FROM (SELECT *, unnest(range(0, least(200, n - a))) AS j FROM k)),
oc AS (SELECT doc_id, n, w, o, d, left(x, d) AS s, substr(x, d + 1, 1) AS c FROM (SELECT *, unnest(range(1, {SIZE - 1})) AS d FROM o) WHERE o + d < n),
pr AS (SELECT *, lag(o) OVER u AS p, lag(c) OVER u AS pc FROM oc WINDOW u AS (PARTITION BY doc_id, s ORDER BY o)),
iv AS (SELECT doc_id, s, o, greatest(o + d - w + 1, 0) AS l, least(p, n - w) AS r FROM pr WHERE pc <> c AND greatest(o + d - w + 1, 0) <= least(p, n - w)),
cl AS (SELECT doc_id, greatest(l, coalesce(lag(r) OVER (PARTITION BY doc_id, s ORDER BY o) + 1, 0)) AS l, r FROM iv),
ch AS (SELECT doc_id, b, sum(x) AS x FROM (SELECT doc_id, l AS b, 1 AS x FROM cl WHERE l <= r UNION ALL SELECT doc_id, r + 1, -1 FROM cl WHERE l <= r) GROUP BY ALL),
wi AS (SELECT doc_id, n, w, o AS b, x FROM o WHERE o <= n - w),
st AS (SELECT wi.doc_id, wi.n, wi.b + 1 AS b, 1 + sum(coalesce(ch.x, 0)) OVER (PARTITION BY wi.doc_id ORDER BY wi.b) AS bn,
 wi.w - coalesce(list_max(list_filter(range(1, wi.w), lambda k: contains(left(wi.x, wi.w - 1), right(wi.x, k)))), 0) AS leaves FROM wi LEFT JOIN ch ON ch.doc_id = wi.doc_id AND ch.b = wi.b),
"""


@query(SWEPT + WINDOW_STATS[WINDOW_STATS.index("ws AS") :] + "SELECT * FROM ws")
def documents_window_stats(spark, sf_dir):
    return windows.window_stats(docs(spark, sf_dir), SIZE)


@query()
def documents_window_stats_1000(spark, sf_dir):
    """All windows of 1,000 characters of every document."""
    return windows.window_stats(docs(spark, sf_dir), 1000)


@query(f"""WITH t AS (SELECT item_id AS doc_id, text AS s FROM benchmark WHERE length(text) > {SIZE}), wi AS (SELECT doc_id, b, substr(s, b, {SIZE}) AS x, substr(s, b + 1, {SIZE - 1}) AS y FROM (SELECT *, unnest(range(1, length(s) - {SIZE} + 1)) AS b FROM t)),
sub AS (SELECT doc_id, b, side, substr(z, i, l) AS v, CASE WHEN i + l <= length(z) THEN substr(z, i + l, 1) END AS nc FROM (SELECT *, unnest(range(1, length(z) + 2 - i)) AS l FROM (SELECT *, unnest(range(1, length(z) + 1)) AS i FROM (SELECT doc_id, b, 0 AS side, x AS z FROM wi UNION ALL SELECT doc_id, b, 1, y FROM wi)))),
nd AS (SELECT doc_id, b, side, v FROM sub GROUP BY ALL HAVING count(DISTINCT nc) >= 2),
lost AS (SELECT doc_id, b, max(length(v)) AS depth FROM nd a WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM nd c WHERE c.doc_id = a.doc_id AND c.b = a.b AND c.side = 1 AND c.v = a.v) GROUP BY ALL),
rp AS (SELECT doc_id, b, {SIZE} - coalesce(list_max(list_filter(range(1, {SIZE}), lambda k: contains(left(x, {SIZE - 1}), right(x, k)))), 0) AS s0, {SIZE} - coalesce(list_max(list_filter(range(1, {SIZE - 1}), lambda k: contains(left(y, {SIZE - 2}), right(y, k)))), 0) AS s1 FROM wi)
SELECT rp.doc_id, rp.b AS slide, CASE WHEN s0 <> s1 THEN rp.b + s0 END AS shortened_to, lost.depth AS merged_depth FROM rp LEFT JOIN lost ON lost.doc_id = rp.doc_id AND lost.b = rp.b""")
def window_slides(spark, sf_dir):
    """What each slide of each text's window takes away."""
    return windows.window_slides(items(spark, sf_dir), SIZE)


@query()
def documents_window_slides(spark, sf_dir):
    """The same for windows of 1,000 characters of every document."""
    return windows.window_slides(docs(spark, sf_dir), 1000)


def window_memory_sql(layout: str) -> str:
    leaf, edge, branch = memory.WINDOW_RECORDS[layout]
    used = f"(least(n, {SIZE}) * {leaf} + floor(avg_edges + 0.5) * {edge} + floor(avg_bn + 0.5) * {branch})"
    return WINDOW_STATS + f"SELECT doc_id, '{layout}' AS layout, CAST({used} AS BIGINT) AS used_bytes, CAST({used} AS DOUBLE) / {SIZE} AS bytes_per_window_char FROM ws"


@query(window_memory_sql("SL"))
def window_memory_sl(spark, sf_dir):
    return memory.window_memory(windows.window_stats(items(spark, sf_dir), SIZE), "SL", SIZE)


@query(window_memory_sql("SH"))
def window_memory_sh(spark, sf_dir):
    return memory.window_memory(windows.window_stats(items(spark, sf_dir), SIZE), "SH", SIZE)


@query(f"""WITH {snapshot_sql()} SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, CAST(p AS INTEGER) AS start, CAST(win_end - p + 1 AS INTEGER) AS leaf_depth, CAST((p - 1) % {2 * SIZE} + 1 AS INTEGER) AS sw_offset,
CAST((p - 1) % {SIZE} + 1 AS INTEGER) AS slot, CAST((p - win_begin) % {2 * SIZE} AS INTEGER) AS depth_order FROM (SELECT *, unnest(range(win_begin, win_end + 1)) AS p FROM sn)""")
def leaf_arithmetic(spark, sf_dir):
    return windows.leaf_arithmetic(windows.snapshots(items(spark, sf_dir), BLOCK, ACTIVE), BLOCK, ACTIVE, 2 * ACTIVE)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 16 AS "begin", l_suppkey % 16 AS "end", l_orderkey % 16 AS "offset" FROM lineitem), y AS (SELECT *, ("begin" - 8 + 16) % 16 AS b FROM x)
SELECT l_orderkey, l_linenumber, "begin", "end", "offset", ("offset" - b + 16) % 16 < CASE WHEN ("end" - b + 16) % 16 = 0 THEN 16 ELSE ("end" - b + 16) % 16 END AS is_valid FROM y""")
def offset_valid(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 16).alias("begin"), (F.col("l_suppkey") % 16).alias("end"), (F.col("l_orderkey") % 16).alias("offset"))
    return windows.offset_valid(rows, 16, 8, batch_update=True)


ENCODINGS = ["UTF-8", "UTF-16LE", "UTF-32BE", "GB18030"]
#: Slices of the documents at most, and bytes of one, by Spark's estimate, that are not worth another.
SLICES, SLICE = 8, 64 << 20


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, '')) AS letter FROM documents WHERE text IS NOT NULL AND text <> ''),
n AS (SELECT letter, count(*) AS n FROM (SELECT letter FROM l UNION ALL SELECT chr(10) FROM documents WHERE text IS NOT NULL) GROUP BY letter)
SELECT e.encoding, n.letter, n.n, sum(n.n) OVER (PARTITION BY e.encoding)::BIGINT AS n_chars FROM n, (VALUES """ + ", ".join(f"('{e}')" for e in ENCODINGS) + ") e(encoding)")
def encoded_files(spark, sf_dir):
    """All documents written to files of several encodings and reread by byte ranges: how often each letter is there, and the characters that the numbered pieces end at.

    A slice of the documents in one encoding is on disk at a time: in UTF-32 alone all of them are several times the input.
    """
    base, texts, found, ends = Scratch(spark, "encoded"), docs(spark, sf_dir), [], dict.fromkeys(ENCODINGS, 0)
    slices = max(1, min(SLICES, trees.size_of(texts) // SLICE))
    for k in range(slices):
        own = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        for name in ENCODINGS:
            folder = f"{k}-{name}"
            files.write_texts(own, f"{base.root}/{folder}", name)
            pieces = files.file_pieces(spark, f"{base.root}/{folder}", name)
            letters = text.letter_counts(pieces.select(F.lit(name).alias("encoding"), "piece"))
            found.append(base.keep(letters.groupBy("encoding", "letter").agg(F.sum("n").alias("n")), "letters"))
            ends[name] += pieces.groupBy("doc_id").agg(F.max(F.col("begin") + F.length("piece")).alias("n")).agg(F.sum("n")).first()[0] or 0
            base.drop(folder)
    letters = reduce(DataFrame.unionByName, found).groupBy("encoding", "letter").agg(F.sum("n").alias("n"))
    return letters.join(F.broadcast(spark.createDataFrame(list(ends.items()), "encoding string, n_chars long")), "encoding")  # one row for each encoding


def streamed(block: int, active: int) -> str:
    """Windows (w) of the conversations, their turns end to end."""
    size = block * active
    return f"""WITH c AS (SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id),
w AS (SELECT *, k * {block} + 1 AS b, least(k * {block} + {size}, n) AS e, n >= {size} AS full_text FROM (SELECT doc_id, s, length(s) AS n, unnest(range(0, greatest(length(s) - {size} + {block - 1}, 0) // {block} + 1)) AS k FROM c WHERE s <> '')),
v AS (SELECT doc_id, CAST(k AS INTEGER) AS window_no, CAST(b AS BIGINT) AS win_begin, CAST(e AS BIGINT) AS win_end, full_text AS is_full, substr(s, b, e - b + 1) AS buffer FROM w)
"""


@query(streamed(100, 2) + "SELECT * FROM v")
def streaming_windows(spark, sf_dir):
    """Windows of each conversation, its turns arriving as a stream, the last one from the state at its end."""
    return streams.run_available(spark, streams.conversation_chunks(spark, sf_dir), 100, 2)


@query(streamed(BLOCK, ACTIVE) + """, sub AS (SELECT * EXCLUDE (buffer), substr(buffer, i, l) AS x, CASE WHEN i + l <= length(buffer) THEN substr(buffer, i + l, 1) END AS nc
FROM (SELECT *, unnest(range(1, length(buffer) + 2 - i)) AS l FROM (SELECT *, unnest(range(1, length(buffer) + 1)) AS i FROM v))),
g AS (SELECT doc_id, window_no, win_begin, win_end, is_full, x, count(*) AS c, count(DISTINCT nc) AS r, max(CASE WHEN nc IS NULL THEN 1 ELSE 0 END) AS ends FROM sub GROUP BY ALL),
st AS (SELECT doc_id, window_no, win_begin, win_end, is_full, 1 + sum(CASE WHEN r >= 2 THEN 1 ELSE 0 END) AS bn, sum(CASE WHEN c = 1 AND ends = 1 THEN 1 ELSE 0 END) AS lv FROM g GROUP BY ALL)
SELECT doc_id, window_no, win_begin, win_end, is_full, CAST(bn AS BIGINT) AS branching_nodes, CAST(lv AS BIGINT) AS leaves, CAST(bn - 1 + lv AS BIGINT) AS edges FROM st""")
def streaming_window_trees(spark, sf_dir):
    """Counts of the tree of each window (8 characters) of the stream of turns."""
    return streams.run_available(spark, streams.conversation_chunks(spark, sf_dir), BLOCK, ACTIVE, trees=True)


@query()
def streaming_window_trees_1000(spark, sf_dir):
    """The same with windows of 1,000 characters that move by 100, beyond SQL; tests hold it against trees of each window."""
    return streams.run_available(spark, streams.conversation_chunks(spark, sf_dir), 100, 10, trees=True)


@query("SELECT k AS layout, a AS algorithm, CAST(0 AS BIGINT) AS differing FROM (VALUES " + ", ".join(f"('{o.layout}{'+B' if o.backward else ''}', '{o.algorithm}')" for o in options.combinations()) + ") v(k, a)")
def algorithm_invariance(spark, sf_dir):
    """Edges of the kernel that differ from those of each algorithm's own construction, for each valid layout.

    A layout is how a tree is stored and has no tree of its own.
    """
    key = ["doc_id", "ord", "label"]
    texts = names(spark, sf_dir)
    layouts: dict[str, list[str]] = {}
    for o in options.combinations():
        layouts.setdefault(o.checked().algorithm, []).append(f"{o.layout}{'+B' if o.backward else ''}")
    # every tree is built once; an edge differs as often as it is there more times by one of the two
    built = [trees.edges(texts).select(*key, F.lit("").alias("by"))] + [trees.classical_edges(texts, a).select(*key, F.lit(a).alias("by")) for a in layouts]
    times = lambda a: F.count(F.when(F.col("by") == a, 1))
    counts = reduce(DataFrame.union, built).groupBy(*key).agg(*(times(a).alias(f"n{i}") for i, a in enumerate(["", *layouts])))
    sums = counts.agg(*(F.coalesce(F.sum(F.abs(F.col(f"n{i}") - F.col("n0"))), F.lit(0)).alias(f"n{i}") for i in range(1, len(layouts) + 1)))
    shown = [F.struct(F.lit(layout).alias("layout"), F.lit(a).alias("algorithm"), F.col(f"n{i}").alias("differing")) for i, (a, keys) in enumerate(layouts.items(), 1) for layout in keys]
    return sums.select(F.inline(F.array(*shown)))


def build(texts: DataFrame, chosen: options.Options) -> DataFrame:
    """Edges as the chosen layout and algorithm show them."""
    e = trees.edges(texts)
    return e if chosen.shows_links else e.withColumn("suffix_link", F.lit(0))
