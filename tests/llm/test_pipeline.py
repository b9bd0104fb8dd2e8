"""The pipeline's run against a composition of brute-force stages."""

import duckdb

import corpus_pipeline
from tests.llm.test_dedup import brute_lines, shingles
from tests.llm.test_text_operators import contaminated
from textrine.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_run(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).collect() if r.kept}
    rows = [(d, t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall() if d in kept]
    lines = brute_lines(rows)
    rows = [(d, lines[d][0]) for d, _ in rows if not lines[d][1] or lines[d][0].strip()]
    # links between any two documents of a sparse similarity graph
    sets, label = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    where: dict = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    pairs = {(a, b) for at in where.values() for a in at for b in at if a < b}
    changed = True
    while changed:
        changed = False
        for a, b in sorted(pairs):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
                low = min(label[a], label[b])
                label = {d: low if x in (label[a], label[b]) else x for d, x in label.items()}
                changed = True
    rows = [(d, t) for d, t in rows if label[d] == d]
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    out = {d for d, _ in contaminated(rows, items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for d, t in rows if d not in out}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 5) for i in range(5)] + [(7, None, None, None, None), (8, "", None, None, 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {0, 1, 2, 3, 4}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert len(corpus_pipeline.STAGES) == 5
