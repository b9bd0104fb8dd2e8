import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from textrine.llm import decontam, html_extract, license_scan, quality_fm, quality_rules
from textrine.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def sql(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.sql(ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    df, want = QUERIES[name](spark, SF), sql(name)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(tuple(r) for r in want.project(", ".join(columns)).fetchall())


# ---- decontamination


def contaminated(docs, items):
    def windows(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for item, text in items:
        w = (text or "").lower().split()
        if item is None or not w:
            continue
        n = min(5, len(w))
        wanted = windows(w, n)
        for d, t in docs:
            if 100 * len(wanted & windows((t or "").lower().split(), n)) >= 75 * len(wanted):
                out.add((d, item))
    return out


def test_decontamination_equals_brute_force(spark):
    import random

    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate((1, 2, 4, 5, 6, 9, 12, 15, 30, 59, 200, 900))] + [(50, None), (51, " "), (None, "w1 w2"), (52, "x y z u v")]
    docs = [(0, None), (1, ""), (2, items[0][1])]
    for i in range(3, 120):
        text = r.choices(words, k=r.choice((3, 50, 400, 3000)))
        for _ in range(r.randint(0, 2)):
            copy = r.choice(items[:12])[1].split()
            if r.random() < 0.4 and len(copy) > 8:
                copy[r.randrange(len(copy))] = "changed"
            a = r.randint(0, len(text))
            text[a:a] = copy
        docs.append((i, " ".join(text).upper() if i % 3 == 0 else " ".join(text)))
    d = spark.createDataFrame([(*x, 0.0) for x in docs], "doc_id long, text string, containment double")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(docs, items)
    assert {(x.doc_id, x.item_id) for x in decontam.matches(d, b).collect()} == want
    kept = {x.doc_id for x in decontam.filter_documents(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontam.matches(d, b.limit(0)).count() == 0 and decontam.matches(d.limit(0), b).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f g h"), (2, "p q r s t u")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f"), (2, "q r s t u"), (3, "p q r s t")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 1)
    assert {(x.doc_id, x.item_id) for x in decontam.matches(d, b).collect()} == {(1, 1), (2, 2), (2, 3)}


# ---- quality


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_rule_counts_equal_brute_force(spark):
    texts = [None, "", " \n ", "a", "a b c d e a b c d e", "x\nx\n\n\nx \nx", "é b #*$%&|<>", "a " * 40, "one two three four five six\n" * 3, "\x1c \x85 \x0b"]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality_rules.judge(df, labels).collect():
        want = rule_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)  # without labels the forest rejects nothing


def test_forest_on_labelled_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    good = [got[d] for d, q in labels if q == 1 and not got[d].base_failed]
    bad = [got[d] for d, q in labels if q == 0 and not got[d].base_failed]
    assert np.mean([r.kept for r in good]) >= 0.995
    assert np.mean([r.kept for r in bad]) <= 0.02
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_isolation_forest_equals_recursion():
    """Paths by a plain recursion that draws the same cuts; rows beyond the sample in one statistic alone are the rarest."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_rules.RATES)))
    x[:, 3] = 0  # a statistic that all ordinary rows share
    forest = quality_rules.IsolationForest(x, trees=9, subsample=100, seed=2)
    odd = np.repeat(x[:1], 3, 0)
    odd[0, 3], odd[1, 0], odd[2, 9] = 2.0, 30, -30
    asked = np.concatenate([x, odd])
    rng = np.random.default_rng(2)
    total = np.zeros(len(asked))
    for _ in range(9):
        part = x[rng.choice(len(x), 100, replace=False)]

        def walk(some, low, high, depth, at):
            if depth == 14 or len(some) < 2:  # 2 * ceil(log2(100))
                n = len(some)
                total[at] += depth + (0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)
                return
            k = rng.integers(10)
            cut = rng.uniform(low[k], high[k])
            end = [cut if j == k else v for j, v in enumerate(high)]
            begin = [cut if j == k else v for j, v in enumerate(low)]
            walk(some[some[:, k] < cut], low, end, depth + 1, at[asked[at, k] < cut])
            walk(some[some[:, k] >= cut], begin, high, depth + 1, at[asked[at, k] >= cut])

        room = [3 * max(a, b) for a, b in zip(part.max(0) - part.min(0), quality_rules.RATES.values())]
        walk(part, list(part.min(0) - room), list(part.max(0) + room), 0, np.arange(len(asked)))
    norm = 2 * (np.log(99) + np.euler_gamma) - 2 * 99 / 100
    got = forest.score(asked)
    assert np.allclose(got, 2.0 ** (-total / 9 / norm))
    many = quality_rules.IsolationForest(x, trees=200, seed=3).score(asked)
    assert many[400:].min() > many[:400].max()


def test_threshold_holds_out():
    """On rows that neither the forest nor its threshold has seen, at most the promised share of ordinary ones goes."""
    rng = np.random.default_rng(4)
    bins = lambda x: np.bincount((x * quality_rules.BINS).astype(int), minlength=quality_rules.BINS + 1)
    lost = found = 0
    for _ in range(20):
        good, bad = rng.beta(4, 20, 3000), rng.beta(30, 10, 200)
        bound = quality_rules.threshold(bins(good), bins(bad), bins(good))
        lost += (rng.beta(4, 20, 3000) > bound).mean() / 20
        found += (rng.beta(30, 10, 200) > bound).mean() / 20
    assert lost <= quality_rules.CLEAN_LOSS and found >= 0.98
    flat = bins(rng.random(5000))
    assert 0.99 < quality_rules.threshold(flat, flat * 0, flat) < 1  # no bad rows
    assert quality_rules.threshold(flat, bins(rng.random(300) / 2), flat) == 2.0  # of no use
    assert quality_rules.threshold(flat * 0, flat, flat) == 2.0


def test_walls_that_no_label_shows(spark):
    """Texts that are odd in one statistic only are rejected, though no labelled row is."""
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(3, 9)))
    text = lambda: "\n".join(" ".join([word() for _ in range(r.integers(8, 13))] + ["7", "A!"] * (r.random() < 0.2)) for _ in range(8))
    rows = [(i, text()) for i in range(300)]
    odd = {1000: " ".join(str(r.integers(10**9)) for _ in range(60)), 1001: " ".join(word() * 9 for _ in range(60)), 1002: " ".join(word() + "!" for _ in range(60)), 1003: " ".join(word().upper() for _ in range(60))}
    docs = spark.createDataFrame([(*x, 1) for x in [*rows, *odd.items()]], "doc_id long, text string, anomaly int")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(5, 1)] * 50, "doc_id long, quality int")
    kept = {x.doc_id for x in quality_rules.filter_documents(docs, labels).collect()}
    assert kept == set(range(300))
    assert {x.doc_id for x in quality_rules.judge(docs, labels).collect() if x.kept} == kept


def test_classifier_on_held_out_rows(spark):
    rows = QUERIES["op7_quality_fm"](spark, SF).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_one_training_row_for_each_id(spark):
    """A labelled id that stands in many rows comes to the driver once, with the text of least hash."""
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 3).alias("text")).union(spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    one = quality_fm.training_rows(docs, labels)
    assert len(one[2]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(30))
    again = quality_fm.training_rows(docs.repartition(7), labels)
    assert all(np.array_equal(a, b) for a, b in zip(one, again))


def test_classifier_corners(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (3, "a b", 5), (3, "a b", 5)], "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality_fm.score(docs, quality_fm.fit(docs, none)).collect()} == {0.5}
    assert quality_fm.score(docs.limit(0), quality_fm.fit(docs.limit(0), none)).count() == 0


def test_sum_of_squares_equals_all_pairs():
    fm = quality_fm.FactorisationMachine(3)
    rng = np.random.default_rng(2)
    fm.w = rng.normal(size=fm.w.shape)
    owner, bucket, value, dense = np.array([0, 0, 1]), np.array([5, 9, 5]), np.array([0.5, 2.0, 1.0]), rng.normal(size=(2, 3))
    got = fm.logits(2, owner, bucket, value, dense)
    for i in range(2):
        x = np.zeros(len(fm.w))
        x[bucket[owner == i]] = value[owner == i]
        x[quality_fm.BUCKETS :] = dense[i]
        at = np.flatnonzero(x)
        want = fm.w0 + fm.w @ x + sum(fm.v[a] @ fm.v[b] * x[a] * x[b] for k, a in enumerate(at) for b in at[k + 1 :])
        assert abs(got[i] - want) < 1e-8


# ---- pages


def test_blocks():
    page = "<html><head><title>t</title><script>'<p>no</p>'</script></head><body><!-- <p>c</p> --><p>a &amp; b<p>c<br>d <b>e</b> f</p>g<ul><li>h<li>i</ul><p>j &lt;k&gt; &#233;</body>"
    assert [t for _, t, _ in html_extract.blocks(page)] == ["a & b", "c d e f", "g", "h", "i", "j <k> é"]
    assert html_extract.blocks(None) == html_extract.blocks("") == html_extract.blocks("<p><div><a href='x'") == []
    assert [t for _, t, _ in html_extract.blocks("1 < 2 and <p class='a>b'>x")] == ["1 < 2 and", "x"]
    assert [k for _, _, k in html_extract.blocks("<p>a <a>bcd</a></p>")] == [3]


def test_blocks_with_svg_and_math():
    found = lambda page: [t for _, t, _ in html_extract.blocks(page)]
    assert found("<p>a <svg class='i' /> b</p><svg/><p>c</p>") == ["a b", "c"]
    assert found("<p>a <svg><text>no</text></svg> b</p><script src='x'/>no</script><p>c</p>") == ["a b", "c"]
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation encoding='t'>no</annotation></semantics></math>"
    assert found(f"<p>so {math} holds</p><p>a <math/> b</p>") == ["so x=12 holds", "a b"]


def test_extraction_finds_the_article(spark):
    rows = QUERIES["op3_html_extraction"](spark, SF).collect()
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    right = 0
    for r in rows:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html_extract.html.unescape(x).split()) for x in re.split(r"<[^>]*>", inner)]
        right += r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    assert len(rows) == len(pages) and right >= 0.98 * len(rows)


def test_extraction_corners(spark):
    noisy = "<body><div class='cookie-banner'>We use cookies</div><header><a href='/'>Site</a></header><nav><a>Home</a></nav><main><h1>Title of it</h1><p>First long paragraph of the article, with words.</p><aside class='ad'>Buy now</aside><p>Second paragraph follows here.</p></main><section id='comments'><h3>Comments</h3><div class='comment'>Great post!</div></section><form><label>Email</label></form><footer>Copyright</footer>"
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<nav><a>Home</a></nav>", 1), (4, "u", noisy, 1), (4, "u", noisy, 1)], "page_id long, url string, html string, text long")
    got = sorted(((r.page_id, r.text) for r in html_extract.extract(df).collect()))
    article = "Title of it\n\nFirst long paragraph of the article, with words.\n\nSecond paragraph follows here."
    assert got == [(1, ""), (2, ""), (3, ""), (4, article), (4, article)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_labeller_on_held_out_layouts():
    from textrine.llm.html_train import accuracy

    assert accuracy(html_extract.Labeller.load(), 150, 1234) >= 0.99


# ---- licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""

GPL = """// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation; either version 2 of the License, or
// (at your option) any later version.
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY.  See the GNU General Public License for more details."""


def test_licences():
    found = lambda t: [(a, len(b)) for a, b, _ in license_scan.scan(t)]
    assert found(MIT) == [("MIT", 4)] and found(GPL) == [("GPL-2.0-or-later", 3)]
    assert found("x\nLicensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", 1)]
    assert found("no stop here ***\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.") == [("GPL-3.0-only", 1), ("MIT", 1)]
    assert found("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.") == [("Apache-2.0", 2)]
    assert found("SPDX-License-Identifier: BSD-3-Clause\n") == [("BSD-3-Clause", 1)]
    assert found("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.") == [("BSD-2-Clause", 3)]
    assert found("the software is provided as is, without warranty of any kind, express or implied, including.") == [("UNMATCHED", 1)]
    assert found(None) == found("") == found("nothing to see") == found("the license plate") == []


def test_license_rows(spark):
    df = spark.createDataFrame([(1, MIT, "x"), (2, None, "x"), (3, "Released under the MIT License." * 1, "x"), (3, "Released under the MIT License.", "x")], "doc_id long, text string, licence string")
    got = sorted((r.doc_id, r.nth, r.licence, r.n_sentences) for r in license_scan.license_scan(df).collect())
    assert got == [(1, 0, "MIT", 4), (3, 0, "MIT", 1), (3, 0, "MIT", 1)]
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_licences_of_the_table(spark):
    """All planted notices, counted by their literal lines."""
    got = Counter(r.licence for r in QUERIES["op1_license_scan"](spark, SF).collect())
    lines = {"GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    lines["UNMATCHED"] = "All rights reserved."
    assert got == Counter({k: n for k, v in lines.items() if (n := sum(t.count(v) for t in texts))})


#: The usual wording of each known sentence.
USUAL = {
    "spdx:{v}": "SPDX-License-Identifier: MIT",
    "gpl-version:{v}": "Licensed under the terms of the GNU General Public License, version 2",
    "lgpl-version:{v}": "Licensed under the GNU Lesser General Public License v3",
    "agpl-version:{v}": "Licensed under the GNU Affero General Public License, Version 3",
    "gpl-modify:{v}": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
    "lgpl-modify:{v}": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; version 2",
    "agpl-modify:{v}": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3",
    "fsf-useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "fsf-details": "See the GNU Lesser General Public License for more details",
    "fsf-copy": "You should have received a copy of the GNU General Public License along with this program",
    "apache-license:{v}": "Licensed under the Apache License, Version 2.0",
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License",
    "apache-or-mit:{v}": "Licensed under either of the Apache License, Version 2.0 or the MIT license",
    "mit-name": "This is available under the terms of the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM",
    "bsd-name:{v}": "Distributed under the 3-Clause BSD License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization",
    "bsd-endorse": "Neither the name of the organization nor the names of its members may be used to endorse or promote products derived from this software",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "isc-liable": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    "mpl-subject:{v}": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one there",
    "epl-terms:{v}": "made available under the terms of the Eclipse Public License v2.0",
    "cc-name:{v}": "Licensed under CC BY-SA 4.0",
    "public-domain": "The work is placed in the public domain",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such",
    "proprietary": "All rights reserved, no part of this may be copied without written permission",
    "rights-reserved": "All rights reserved",
    "no-part": "No part of this work may be copied without prior written permission",
    "gnu-short:{v}": "This is released under the GPLv2",
    "boost-name:{v}": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
    "unauthorised": "Unauthorised copying of this file, via any medium, is strictly prohibited",
}


def test_every_known_sentence_is_found():
    assert set(USUAL) == {name for name, _ in license_scan.SENTENCES}
    for name, text in USUAL.items():
        wrapped = "// " + text.replace(" ", "\n// ") + "."
        for t in (text, wrapped):
            ids = [x for _, s in license_scan.sentences(t) for x in license_scan.identify(s)]
            assert [x.split(":")[0] for x in ids] == [name.split(":")[0]], (name, ids)
            assert len(license_scan.scan(t)) == 1, name


def test_one_name_for_each_licence():
    name = lambda t: [a for a, _, _ in license_scan.scan(t)]
    for texts, licence in {
        ("Licensed under CC0 1.0", "Licensed under CC0.", "SPDX-License-Identifier: CC0-1.0", "licensed under Creative Commons Zero v1.0"): "CC0-1.0",
        ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0.", "licenced under CC-BY-NC-4.0"): "CC-BY-NC-4.0",
        ("SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU General Public License, version 2."): "GPL-2.0-only",
        ("SPDX-License-Identifier: GPL-2.0+", "SPDX-License-Identifier: gpl-2.0-or-later", "Licensed under the GNU General Public License v2 or later.", GPL): "GPL-2.0-or-later",
        ("SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License", "Released under the 3-clause BSD license."): "BSD-3-Clause",
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."): "Apache-2.0 OR MIT",
        ("SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."): "MPL-2.0",
        ("SPDX-License-Identifier: ISC", USUAL["isc-grant"] + ", provided that the above copyright notice appears.\n\n" + USUAL["isc-warranty"] + " including.\n" + USUAL["isc-liable"]): "ISC",
        ("SPDX-License-Identifier: Zlib", ". ".join(USUAL[f"zlib-{x}"] for x in ("as-is", "liable", "grant", "origin", "altered"))): "Zlib",
        ("SPDX-License-Identifier: Unlicense", USUAL["unlicense-free"] + ".\n\n" + USUAL["unlicense-anyone"] + ", either in source code form or as a binary."): "Unlicense",
        ("SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are " + USUAL["epl-terms:{v}"] + " which is available there."): "EPL-2.0",
        ("SPDX-License-Identifier: AGPL-3.0-or-later", GPL.replace("GNU General", "GNU Affero General").replace("version 2", "version 3")): "AGPL-3.0-or-later",
        ("SPDX-License-Identifier: LGPL-2.1", GPL.replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1").replace("any later version", "none other")): "LGPL-2.1-only",
    }.items():
        for t in texts:
            assert name(t) == [licence], t


def brute_rules(ids):
    """The first rule that matches at each place, by trying every way to leave out what may be missing."""
    import itertools

    ways = []
    for sequence, licence in license_scan.RULES:
        tokens = sequence.split()
        for drop in itertools.product(*([True, False] if t.endswith("?") else [True] for t in tokens)):
            ways.append(([t.rstrip("?") for t, d in zip(tokens, drop) if d], licence))
    out, at = [], 0
    while at < len(ids):
        for wanted, licence in ways:
            i, named = at, ""
            for k, w in enumerate(wanted):
                gap = 0
                while k and i < len(ids) and ids[i] == "?" and gap < license_scan.GAP:
                    i, gap = i + 1, gap + 1
                m = re.fullmatch(re.escape(w).replace(r"\{v\}", "(.+)"), ids[i]) if i < len(ids) else None
                if not m:
                    break
                named = named or (m[1] if m.groups() else "")
                i += 1
            else:
                out.append((licence.replace("{v}", named), i - at))
                at = i
                break
        else:
            out.append(("UNMATCHED", 1)) if ids[at] != "?" else None
            at += 1
    return out


def test_rules_equal_brute_force():
    r = random.Random(3)
    for _ in range(400):
        rule = [t.rstrip("?").replace("{v}", "2.0") for t in r.choice(license_scan.RULES)[0].split() if not t.endswith("?") or r.random() < 0.6]
        ids = []
        for x in rule + r.choices(sorted(USUAL), k=r.randint(0, 3)):
            ids += ["?"] * r.choice((0, 0, 0, 1, 2, 3)) + [x.replace("{v}", "2.0")]
        words = ["nothing known here" if x == "?" else USUAL[x.replace("2.0", "{v}").replace("-later", "")] + (" or later" if x.endswith("-later") else "") for x in ids]
        ids = ["?" if x == "?" else license_scan.identify(license_scan.sentences(w)[0][1])[0] for x, w in zip(ids, words)]
        for i, x in enumerate(ids):
            if x == "rights-reserved" and next((y for y in ids[i + 1 : i + 4] if y != "?"), x) not in ("no-part", "unauthorised", "proprietary", "rights-reserved"):
                ids[i] = "?"
        assert [a for a, _, _ in license_scan.scan("\n\n".join(words))] == [a.replace("_", " ") for a, _ in brute_rules(ids)], words


def test_a_very_long_text():
    long = "word " * 400_000 + "\nReleased under the MIT License.\n" + "no stop " * 100_000
    assert [a for a, _, _ in license_scan.scan(long)] == ["MIT"]


def test_four_clauses():
    clauses = [USUAL[x] for x in ("bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")]
    for marks in (("1.", "2.", "3.", "4."), "****"):
        text = USUAL["bsd-grant"] + ":\n" + "".join(f"{a} {b}.\n" for a, b in zip(marks, clauses))
        assert [(a, len(b)) for a, b, _ in license_scan.scan(text)] == [("BSD-4-Clause", 5)]


def test_ordinary_headers():
    found = lambda t: [a for a, _, _ in license_scan.scan(t)]
    gnu = "you can redistribute it and/or modify it under the terms of"
    for text, licences in {
        f"{gnu} the GNU General Public License version 2 as published by the Free Software Foundation.": ["GPL-2.0-only"],
        f"{gnu} the GNU General Public License, version 3, as published by the Free Software Foundation, or any later version.": ["GPL-3.0-or-later"],
        f"{gnu} version 2.1 of the GNU Lesser General Public License as published by the Free Software Foundation.": ["LGPL-2.1-only"],
        "Distributed under the Apache License, Version 2.0": ["Apache-2.0"], "Licensed under the Apache 2.0 License": ["Apache-2.0"],
        "Licensed under the Apache License, Version 2.0 or the MIT license": ["Apache-2.0 OR MIT"],
        "License: MIT": ["MIT"], "License: apache-2.0\n\nUnter der License mit Bedingungen.": ["Apache-2.0"], "The license plate is new.": [],
        "available under the Creative Commons Attribution-ShareAlike 3.0 License": ["CC-BY-SA-3.0"],
        "released under the GNU General Public License v3": ["GPL-3.0-only"], "Licensed under the GPLv3": ["GPL-3.0-only"], "Provided under GPL-2.0+.": ["GPL-2.0-or-later"],
        "Covered by the LGPLv2.1 or later": ["LGPL-2.1-or-later"], "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + USUAL["boost-grant"]: ["BSL-1.0"],
        "This is not licensed under the MIT license": [], "It was never released under the terms of the GNU General Public License v2.": [],
        "This isn't available under the Apache License 2.0, but is available under the MIT license.": ["MIT"],
        "Copyright 2020 X. All rights reserved.": ["UNMATCHED"], "All rights reserved.\n" + MIT: ["MIT"],
        "All rights reserved. No part of it " + "and its parts " * 60 + "may be copied without permission.": ["Proprietary"],
    }.items():
        assert found(text) == licences, text


def test_expressions():
    found = lambda t: [a for a, _, _ in license_scan.scan(t)]
    for text, licence in {
        "(MIT OR Apache-2.0) AND BSL-1.0": "(MIT OR Apache-2.0) AND BSL-1.0", "MIT OR (Apache-2.0 AND BSL-1.0)": "MIT OR Apache-2.0 AND BSL-1.0", "((mit))": "MIT",
        "GPL-2.0-or-later WITH Classpath-exception-2.0 */": "GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0+ with classpath-exception-2.0": "GPL-2.0-or-later WITH Classpath-exception-2.0",
        "BSD-2-clause-patent": "BSD-2-Clause-Patent", "LicenseRef-Acme": "LicenseRef-Acme", "DocumentRef-a:LicenseRef-b AND MIT": "DocumentRef-a:LicenseRef-b AND MIT",
        "MIT and then some more words": "MIT", "MIT or apache-2.0": "MIT OR Apache-2.0", "MIT OR (ISC": "MIT", "(MIT AND (ISC OR (Zlib AND 0BSD))) OR X11": "MIT AND (ISC OR Zlib AND 0BSD) OR X11",
    }.items():
        assert found(f"/* SPDX-License-Identifier: {text}\nint x; See above.") == [licence], text
    assert found("SPDX-License-Identifier: (MIT OR\n") == found("SPDX-License-Identifier: )\n") == found("SPDX-License-Identifier:") == []


def test_proprietary_notices():
    part = "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher."
    found = lambda t: [(a, len(b)) for a, b, _ in license_scan.scan(t)]
    for notice in (part, "Unauthorized copying of this file,\nvia any medium, is strictly prohibited."):
        assert found(f"Copyright 2020 X. All rights reserved. {notice}") == [("Proprietary", 2)]
        assert found(f"All rights reserved.\n\nOne. Two. {notice}") == [("Proprietary", 2)]
        assert found(f"All rights reserved.\nOne. Two. Three. {notice}") == [("UNMATCHED", 1)] * 2
        assert found(notice) == [("UNMATCHED", 1)]
    assert found(f"All rights reserved. {part} Unauthorised use is prohibited.") == [("Proprietary", 3)]
    assert found("All rights reserved, no part may be copied without permission.") == [("Proprietary", 1)]
    assert found("Copyright 2020 X. All rights reserved. " + MIT) == [("MIT", 4)]
