import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from textrine.llm import line_dedup, near_dup, suffix_dedup
from textrine.llm.common import Scratch

WORDS = [f"w{i}" for i in range(400)]


def brute_lines(rows):
    """Texts after deleting lines covered by a run of 20 characters or three lines that occurred earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        cover = set()
        for j in range(len(at)):
            key = ()
            for i in at[j : j + 3]:
                key += (lines[i].strip(" \t\r"),)
                if len(key) == 3 or sum(map(len, key)) >= 20:
                    if key in seen:
                        cover.update(range(at[j], i + 1))
                    seen.add(key)
                    break
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in cover), len(cover))
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(["a", "b ", "c", "", "\td", "twelve chars", "a line of twenty chs", "one of nineteen chs", f"a line of its own: {r.random()}"]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x\ny\nz"), (103, "0\nx\ny\nz\n1"), (104, "x\ny"), (105, "x\ny\nz\n" * 40), (106, "y" * 300_000), (107, "own\n" + "y" * 300_000), (108, "a\n" * 50_000)]
    df = spark.createDataFrame([(*x, "kept", 1) for x in rows], "doc_id long, text string, runs string, _n_removed int")
    got = {x.doc_id: x for x in line_dedup.dedup_lines(df).collect()}
    assert len(got) == len(rows) and got[100].text is None and all(x.runs == "kept" and x._n_removed == 1 for x in got.values())
    removed = {x.doc_id: x.n_removed for x in line_dedup.digests(df).collect()}
    for doc_id, (text, n) in brute_lines(rows).items():
        assert (got[doc_id].text, removed[doc_id]) == (text, n), doc_id
    kept = {x.doc_id: x for x in line_dedup.filter_documents(df.withColumn("n_chars", F.lit(-1))).collect()}
    assert set(kept) == {d for d in got if got[d].text is None or got[d].text.strip() or not removed[d]}
    assert all(x.n_chars == (len(x.text) if removed[d] else -1) for d, x in kept.items())


def test_line_corners(spark):
    twice = spark.createDataFrame([(1, "p\nq\nr")] * 2 + [(2, "p\nq\nr"), (None, "p\nq\nr\ns")], "doc_id long, text string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_removed) for x in line_dedup.digests(twice).collect())
    assert got == [(-1, 0), (1, 3), (1, 3), (2, 3)]  # a null id comes first, so the others repeat it
    assert line_dedup.digests(twice.limit(0)).count() == 0


def shingles(text):
    w = [] if text is None else [x.lower() for x in text.encode().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[b] < label[a]:
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        label[a], changed = label[b], True
    return {d: (len(sets[d]), label[d]) for d in sets}


def near_rows(seed, groups=6, copies=14):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  TWO"), (4, "\n \t")]
    for _ in range(groups):
        base = r.choices(WORDS, k=r.randint(8, 120))
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
                text[r.randrange(len(text))] = r.choice(WORDS)
            rows.append((len(rows) * 7 % 997 + 10, " ".join(text)))
    return list(dict(rows).items())


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows(2)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in near_dup.filter_documents(df).collect()}
    assert kept == {d for d, (_, c) in got.items() if c == d}


def test_chains_of_copies(spark):
    """Neighbours are similar, the ends are not: one component all the same."""
    words = random.Random(4).choices(WORDS, k=60)
    rows = []
    for i in range(25):
        rows.append((i + 1, " ".join(words)))
        words = words[1:] + [f"new{i}"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dup.near_duplicates(df).collect()} == {1}


def test_a_group_with_many_changes_of_their_own(spark):
    r = random.Random(8)
    base = r.choices(WORDS, k=100)
    rows = []
    for i in range(60):
        text = list(base)
        for k in range(r.choice((0, 1, 2, 4, 5, 6, 8))):
            text[r.randrange(100)] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(df).collect()} == brute_components(rows)


def test_near_corners(spark):
    df = spark.createDataFrame([(5, "a b c d e f")] * 2 + [(None, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == [(False, 5, 5, True), (False, 5, 5, True), (False, 9, 5, False), (True, None, None, True)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Every row is judged by its own text: (7, A) has no copy and stays, (7, B) repeats (3, B)."""
    a, b, c = ("w" + " w".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (7, a), (7, b), (9, a + " end"), (9, c), (11, c + " end"), (2, c)]
    df = spark.createDataFrame([(*x, "x", 5) for x in rows], "doc_id long, text string, th string, `a.b` int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(2, 2, True), (3, 3, True), (7, 3, False), (7, 7, True), (9, 2, False), (9, 7, False), (11, 2, False)]
    kept = {(r.doc_id, r.text, r.th, r[3]) for r in near_dup.filter_documents(df).collect()}
    assert kept == {(3, b, "x", 5), (7, a, "x", 5), (2, c, "x", 5)}


def test_repeated_rows_of_near_copies(spark):
    """A row that stands several times counts once in every comparison and keeps all its rows."""
    words = [f"w{i}" for i in range(60)]
    near, far = words[:59] + ["end"], [f"v{i}" for i in range(60)]
    rows = [(5, words)] * 3 + [(2, near)] * 4 + [(8, far)] * 2 + [(9, far[:30] + words[:30])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(2, 56, 2, True)] * 4 + [(5, 56, 2, False)] * 3 + [(8, 56, 8, True)] * 2 + [(9, 56, 9, True)]
    assert sorted(r.doc_id for r in near_dup.filter_documents(df).collect()) == [2] * 4 + [8] * 2 + [9]


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = spark.createDataFrame([(1, i) for i in range(20)] + [(2, i) for i in range(3)], "key long, id long")
    x, y = (r.select("key", "block", F.col("id").alias(i)) for i, r in zip("ab", near_dup.blocked(rows, "key")))
    got = sorted((r.key, r.a, r.b) for r in x.join(y, ["key", "block"]).where("a < b").collect())
    assert got == sorted((k, a, b) for k, n in ((1, 20), (2, 3)) for b in range(n) for a in range(b))
    rows = near_rows(5, groups=3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(rows)


def test_signature_difference(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << near_dup.BITS, (50, near_dup.SYMBOLS))
    b = np.where(rng.random(a.shape) < 0.4, rng.integers(0, 1 << near_dup.BITS, a.shape), a)
    pack = lambda x: [sum(int(x[near_dup.PER * i + j]) << (near_dup.STEP * j) for j in range(near_dup.PER)) for i in range(near_dup.LANES)]
    df = spark.createDataFrame([(pack(x), pack(y), int((x != y).sum())) for x, y in zip(a, b)], "sa array<long>, sb array<long>, n int")
    assert df.where(f"({near_dup.differing('sa', 'sb')}) != n").count() == 0


def brute_bytes(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    where: dict[bytes, list] = {}
    for k, (_, raw) in enumerate(raws):
        for p in range(len(raw) - length + 1):
            where.setdefault(raw[p : p + length], []).append((k, p))
    marks = [np.zeros(len(raw), bool) for _, raw in raws]
    for at in where.values():
        if len(at) > 1:
            for k, p in at:
                marks[k][p : p + length] = True
    out = []
    for (d, raw), m in zip(raws, marks):
        rest = bytes(np.frombuffer(raw, np.uint8)[~m])
        starts = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(m) else 0
        out.append((d, len(raw), int(m.sum()), starts, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def byte_rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh é", k=r.randint(2, 9)))
    passage = " ".join(word() for _ in range(140))
    other = " ".join(word() for _ in range(300))
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 399), (4, "a" * 900), (5, passage * 3), (6, other), (7, other), (7, other), (8, "x" + other)]
    for i in range(9, 60):
        own = [" ".join(word() for _ in range(r.randint(5, 120))) for _ in range(2)]
        a = r.randint(0, 300)
        rows.append((i, own[0] + r.choice((passage, passage[a:], passage[: 250 + a], other[a : a + r.randint(380, 700)])) + own[1]))
    return rows


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_substrings_equal_brute_force(spark):
    rows = byte_rows(3)
    df = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, raw string")
    want = brute_bytes(rows, suffix_dedup.LENGTH)
    assert rows_of(suffix_dedup.dedup(df)) == want
    assert rows_of(suffix_dedup.dedup(df, batches=3, share=2, group=2)) == want  # hot classes by broadcast, hot prefixes by counted windows
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_batches_come_one_by_one(spark, tmp_path):
    """A stored family is opened again for each further batch; its candidates give the union's brute force."""
    rows = byte_rows(6)
    batches = [spark.createDataFrame(rows[i::5], "doc_id long, text string") for i in range(5)]
    suffix_dedup.IndexFamily(spark, f"file://{tmp_path}/family").add(batches[0])
    for batch in batches[1:]:
        family = suffix_dedup.IndexFamily.open(spark, f"file://{tmp_path}/family")
        family.add(batch)
        ranks = [rank for rank, _ in family.levels]
        assert ranks == sorted(set(ranks), reverse=True)  # geometric: no two levels of a rank stay
        family.close(delete=False)
    family = suffix_dedup.IndexFamily.open(spark, f"file://{tmp_path}/family")
    assert [rank for rank, _ in family.levels] == [2, 0]
    grams = [r.gram for r in family.read(family.levels[0][1]).where("spark_partition_id() = 0").collect()]
    assert grams == sorted(grams)
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.removed_ranges(suffix_dedup.matches(docs, family.candidates(), scratch)).collect()
    got = {r.did: sum(b - a for a, b in suffix_dedup.merged(((x.a, x.b) for x in r.ranges), 10**9)) for r in found}
    assert got == {d: removed for d, _, removed, _, _ in brute_bytes(rows, suffix_dedup.LENGTH) if removed}


def test_wide_prefixes_are_cut_in_slices(spark, monkeypatch):
    """Of a prefix with many classes no task compares all windows; each window is compared once, and the result is the same."""
    rows = byte_rows(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, dealt = suffix_dedup.sliced, []
    monkeypatch.setattr(suffix_dedup, "WIDE", 2)
    monkeypatch.setattr(suffix_dedup, "sliced", lambda spans, wide: dealt.append(wide.count()) or kept(spans, wide))
    assert rows_of(suffix_dedup.dedup(df)) == brute_bytes(rows, suffix_dedup.LENGTH) and dealt[0] > 0
    base = random.Random(8).randbytes(768)
    spans = spark.createDataFrame([(1, i, 0, 500, o, base[368 - o : 368 - o + n]) for i, (o, n) in enumerate([(368, 768), (368, 400), (0, 400), (200, 500)])] + [(2, 9, 0, 500, 368, base)], "key long, did long, th long, at int, o int, raw binary")
    found = kept(spans, spark.createDataFrame([(1,)], "key long")).collect()
    windows = lambda rows: sorted((r.key, r.did, r.at - r.o + w, bytes(r.raw[w : w + 400])) for r in rows for w in range(len(r.raw) - 399))
    assert windows(found) == windows(spans.collect())
    places: dict[tuple, set] = {}
    for r in found:
        places.setdefault((r.key, r.slice), set()).update(r.o - w for w in range(len(r.raw) - 399))
    assert len(places[2, 0]) == 369 and all(len(places[1, s]) <= 47 for s in range(8)) and sum(len(places[1, s]) for s in range(8)) == 369


def test_kept_bytes_and_null_id(spark):
    text = "".join(random.Random(9).choices("abcdef ", k=1000))
    df = spark.createDataFrame([(None, text + "1"), (1, "2" + text)], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.text, r.repeats) for r in suffix_dedup.dedup(df).collect()}
    assert got == {None: (b"1", "1", True), 1: (b"2", "2", True)}
    df = spark.createDataFrame([(1, "é" + text), (2, "è" + text), (3, "own é")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.text, r.repeats) for r in suffix_dedup.dedup(df).collect()}
    assert got == {1: ("é".encode(), "é", True), 2: ("è".encode(), "è", True), 3: ("own é".encode(), "own é", False)}
    df = spark.createDataFrame([(1, text + "é"), (2, text + "è")], "doc_id long, text string")  # the first byte of both is C3
    assert {r.doc_id: (bytes(r.kept), r.text) for r in suffix_dedup.dedup(df).collect()} == {1: (b"\xa9", ""), 2: (b"\xa8", "")}


def test_long_texts_are_cut_in_overlapping_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    r = random.Random(5)
    raw = bytes(r.choices(b"abcdefghij", k=5000))
    seen = set()
    for group in suffix_dedup.parts([raw, b"x" * 10, raw[:900]]):
        row, at, p1, p2, *_ = suffix_dedup.anchors(group)
        assert (p1 <= p2).all() and (at >= p2).all() and (at + suffix_dedup.GRAM <= p1 + suffix_dedup.LENGTH).all()
        for k, a, b in zip(row, p1, p2):
            seen.update((int(k), p) for p in range(a, b + 1))
    assert seen == {(0, p) for p in range(5000 - 399)} | {(2, p) for p in range(900 - 399)}


def test_near_dup_gives_workers_few_texts_at_once(spark, monkeypatch):
    """The batches that the shingles are made from are bounded in rows, and the session's setting is as before."""
    from textrine.llm import common, near_dup

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given, seen = spark.conf.get(key), []
    keep = common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, name, *a: (seen.append((name, int(self.spark.conf.get(key)))), keep(self, df, name, *a))[1])
    df = spark.createDataFrame([(i, f"some words that are the same in all of {i % 2} of these texts here") for i in range(6)], "doc_id long, text string")
    assert near_dup.near_duplicates(df).count() == 6
    assert {n for name, n in seen if name == "sketch"} == {1000} and spark.conf.get(key) == given
