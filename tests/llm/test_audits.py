"""Operators 11 to 13 against brute force on small tables, with all corners."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from textrine.llm import embed_dedup, filter_audit, source_divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, term string"
LABELS = "doc_id long, quality int, toxic int, part string"


def documents():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "äther", "Ärger", "a&b", "50%", "x", "délta epsilon"]
    rows = []
    for i in range(90):
        text = " ".join(r.choice(words[: r.randint(2, 9)]) + r.choice(["", "", str(r.randint(0, 9))]) for _ in range(r.choice([0, 3, 40, 210, 400])))
        rows.append((i * 3, text if r.random() < 0.9 else None, r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "c", None])))
    rows += [(500 + i, rows[i % 7][1], "en", "hot") for i in range(60)]  # copies, some of null and empty texts
    rows += [(7, "one text twice under one id", "en", "a")] * 2 + [(None, "one text twice under one id", "de", "a")] * 2 + [(None, "of null ids only", "de", "z")] * 3
    rows += [(900, "long word " * 60_000, "xx", "only"), (901, "é" * 200_000, "xx", "only"), (902, "", "yy", "s"), (903, None, "yy", "t")]
    r.shuffle(rows)
    return [(*x, -1, "own", 3, 9, "t") for x in rows]


def brute_audit(rows, labels):
    word = re.compile("[^\x20\x09-\x0d]+")
    least, good, toxic = {}, defaultdict(int), defaultdict(int)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    for doc_id, q, t, _ in labels:
        good[doc_id] |= q == 1
        toxic[doc_id] |= t == 1
    judged = defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = word.findall(t)
        copy = t in least and (doc_id is None or least[t] < doc_id)
        fails = "".join(f for f, x in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(set(t) & set("#$%&*|")), copy]) if x)
        judged[lang or ""].append((fails, doc_id is not None and good[doc_id], doc_id is not None and toxic[doc_id]))
    out = set()
    for part, docs in judged.items():
        shapley, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                shapley[f] += len(here)
                lines.append((order, step, f, len(left), len(here), failing - len(here), sum(d[0] == f for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)))
        out |= {(part, x[0], x[1], *x[3:], shapley[x[2]]) for x in lines}
    return out


@pytest.mark.parametrize("chunk", [filter_audit.CHUNK_BYTES, 500])
def test_filter_audit(spark, monkeypatch, chunk):
    monkeypatch.setattr(filter_audit, "CHUNK_BYTES", chunk)
    rows = documents()
    r = random.Random(4)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for i in range(0, 560, 2)] * 2 + [(0, 1, 0, "x"), (None, 1, 1, "x"), (7, 1, 1, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == [x.split()[0] for x in filter_audit.SCHEMA.split(", ")]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_chains_of_one_fingerprint(monkeypatch):
    """Different texts with one fingerprint stay apart, and the smallest id holds each."""
    monkeypatch.setattr("xxhash.xxh64_intdigest", lambda raw: 5)
    sent = list(filter_audit.first_of_chunk([(4, "p", "en"), (2, "p", "fr"), (9, "q", "en"), (2, "p", "fr")])) + list(filter_audit.first_of_chunk([(1, "q", "en"), (3, "p", "en"), (None, "q", "de")]))
    got = sorted((-1 if d is None else d, part, m >> 4, n) for d, part, m, n in filter_audit.judged_chains(sent))
    assert got == [(-1, "de", 1, 1), (1, "en", 0, 1), (2, "fr", 0, 2), (3, "en", 1, 1), (4, "en", 1, 1), (9, "en", 1, 1)]


def brute_divergence(rows):
    texts = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {x[0] for x in texts}:
        mine = [x for x in texts if x[0] == lang]
        df = Counter(t for _, _, w in mine for t in set(w))
        kept = [t for t in df if df[t] >= 3]
        price = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        counts = {s: Counter(t for _, x, w in mine if x == s for t in w if df[t] >= 3) for s in {x[1] for x in mine}}
        whole = sum(counts.values(), Counter())
        p = {s: {t: price(c[t], sum(c.values())) for t in kept} for s, c in counts.items()}
        q = {t: price(whole[t], sum(whole.values())) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:200]
            out |= {(lang, s, part, item.decode(), -v, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(ranked, 1)}
    return out


def test_source_divergence(spark, monkeypatch):
    rows = documents()
    rows += [(2000 + i, " ".join(f"t{j:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(700)) + " x" * i, "big", "ab"[i % 2]) + rows[0][4:] for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_divergence(rows)
    for held in (source_divergence.HELD_TERMS, 20):
        monkeypatch.setattr(source_divergence, "HELD_TERMS", held)
        got = [tuple(x) for x in source_divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {("yy", "s", "pair", "t", 0, 1), ("yy", "t", "pair", "s", 0, 1)} <= want  # no kept terms
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_billionths_of_large_counts(spark):
    """Division in steps is exact where a billion times the count is no long."""
    cases = [(c, t) for t in (1, 7, 10**9 + 7, 9 * 10**15 - 1) for c in (0, t // 3, t - 1)]
    got = spark.createDataFrame(cases, "c long, t long").selectExpr("c", "t", f"{source_divergence.per_billion('c', 't')} AS p").collect()
    assert all(x.p == 1 + 10**9 * (x.c + 1) // x.t for x in got)


VECTORS = "vec_id long, embedding array<float>, label int, node string, key long, links int"


def brute_links(rows):
    ok = [i for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    x = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    near = defaultdict(set)
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt(x[i] @ x[i]) / np.sqrt(x[j] @ x[j]) >= 0.93:
                near[i].add(j)
    out = []
    for i, (v, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] | {k for k in ok if rows[k][0] == rows[i][0] and i in ok}:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = v if i not in ok else min(rows[j][0] for j in seen)
        out.append((-1 if v is None else v, len(near[i]), c, v is None or v == c))
    return sorted(out, key=str)


def vectors():
    r = np.random.default_rng(5)
    rows = []
    for c in range(12):
        center = r.standard_normal(24)
        for _ in range(int(r.integers(1, 14))):
            rows.append([float(x) for x in center + r.standard_normal(24) * r.choice([0.0, 0.05, 0.25, 0.36])])
    table = [(int(i), e, int(r.integers(0, 2))) for i, e in zip(r.permutation(len(rows)) * 2, rows)]
    table += [(1001 + i, rows[0], 0) for i in range(70)] + [(2001 + i, [x * 1e-20 for x in rows[0]], 0) for i in range(3)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23]
    table += [(3000 + 2 * i + j, e, 0) for i, e in enumerate(odd) for j in range(2)]
    table += [(4000, rows[1], None), (4001, rows[1], None), (None, rows[1], 0), (None, rows[1], 0), (4004, [1.0, 2.0], 0), (4005, [1.0, 2.0], 0), (4006, [3e38, 3e38], 0)]
    return table + [table[3]] * 2


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 6])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*x, "own", 5, 1) for x in rows], VECTORS).repartition(3)
    got = sorted(((-1 if x.vec_id is None else x.vec_id, x.n_links, x.component_id, x.kept) for x in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == brute_links(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    if block == 6:
        wide = df.withColumn("embedding", df.embedding.cast("array<double>"))
        assert embed_dedup.near_duplicates(wide).count() == len(rows)


def test_tables_keep_pairs_at_the_threshold():
    """Pairs of cosine 0.93 share a bucket in nearly all cases at any planned size; unrelated ones seldom share one table's."""
    r = np.random.default_rng(6)
    a = embed_dedup.unit_rows(r.standard_normal((2000, 64)))
    other = r.standard_normal((2000, 64))
    other = embed_dedup.unit_rows(other - (other * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
    for n in (200, 5_000, 1_000_000):
        k, tables = embed_dedup.plan(n)
        x, y, z = (embed_dedup.bucket_keys(v, np.zeros(2000, np.int64), k, tables) for v in (a, b, other))
        assert (x == y).any(1).mean() > 0.998
        assert (x == z).mean() * n < 2.5 * embed_dedup.CHANCE
        again = embed_dedup.bucket_keys(a[7:8], np.zeros(1, np.int64), k, tables)
        assert (again == x[7:8]).all()
