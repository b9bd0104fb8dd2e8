import numpy as np
from pyspark.sql import functions as F

from textrine.llm import sharding
from textrine.llm.common import Scratch, WordHashes, batch_shingles, bitmap_of, distinct_per_text, in_bitmap, slices


def test_shingles_are_windows_of_words():
    texts = ["a b c d e f", "A B c d E", "a b", "", None, "a b c d e a b c d e", "  \t\n"]
    hashes, offsets = batch_shingles(texts, WordHashes())
    assert np.diff(offsets).tolist() == [2, 1, 1, 0, 0, 6, 0]
    assert hashes[0] == hashes[offsets[1]] and hashes[offsets[5]] == hashes[offsets[5] + 5] == hashes[0]
    values, bounds = distinct_per_text(hashes, offsets)
    assert np.diff(bounds).tolist() == [2, 1, 1, 0, 0, 5, 0]


def test_slices_cover_everything():
    assert list(slices([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)] and list(slices([], 3)) == []


def test_bitmap(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"))
    bits = bitmap_of(df, "h").value
    assert in_bitmap(bits, np.array([r.h for r in df.collect()])).all()
    assert in_bitmap(bits, np.array([r.h for r in spark.range(500, 1500).select(F.xxhash64("id").alias("h")).collect()])).sum() < 5


def test_scratch(spark):
    s = Scratch(spark, "test")
    df = s.keep(spark.range(3), "x")
    assert df.count() == 3
    s.drop(df)


def brute_table(names, slots):
    import hashlib

    n = lambda tag, name: int(hashlib.md5(f"{tag}:{name}".encode()).hexdigest()[:15], 16)
    orders = [[(n("offset", x) % slots + j * (n("step", x) % (slots - 1) + 1)) % slots for j in range(slots)] for x in names]
    table, taken = {}, [iter(o) for o in orders]
    while len(table) < slots:
        for i, order in enumerate(taken):
            slot = next((s for s in order if s not in table), None)
            if slot is not None:
                table[slot] = i
    return [table[s] for s in range(slots)]


def test_table_equals_brute_force():
    names = sharding.shard_names(7)
    table = sharding.fill(names, 211)
    assert table == brute_table(names, 211)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.25 * 211


def test_placement(spark):
    import hashlib

    rows = [(None, "x"), (1, "y"), (1, "z"), (10**12, None)]
    df = spark.createDataFrame(rows, "doc_id long, shard string")  # a clashing column is overwritten
    table = sharding.fill(sharding.shard_names(), sharding.SLOTS)
    for r in sharding.place(df, "doc_id").collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(df.limit(0), "doc_id").count() == 0


def test_hot_keys_are_spread(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    spread = sharding.spread(df, "source", 50, "doc_id")
    assert spread.where("source = 'hot'").select("placement_key").distinct().count() == 6 and spread.count() == 400
    assert spread.where("source <> 'hot' AND placement_key <> source").count() == 0
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), sharding.shard_names(4), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_spread_keeps_columns_of_any_name(spark):
    rows = [("a", i, "x", 7, i, "old") for i in range(30)] + [(None, i, None, None, None, None) for i in range(30, 50)] + [("b", 99, "y", 1, 2, "old")]
    df = spark.createDataFrame(rows, "key string, hot long, _parts string, parts long, `a.b` long, placement_key string")
    out = sharding.spread(df, "key", 10, "hot")
    assert out.columns == ["key", "hot", "_parts", "parts", "a.b", "placement_key"]
    got = out.collect()
    assert sorted((str(r.key), r.hot, r[4]) for r in got) == sorted((str(r[0]), r[1], r[4]) for r in rows)
    made = {k: {r.placement_key for r in got if r.key == k} for k in ("a", None, "b")}
    assert made["b"] == {"b"} and made["a"] <= {"a#0", "a#1", "a#2"} and made[None] <= {"#0", "#1"} and len(made["a"]) == 3
    # the same row gets the same sub-key whatever the number of salts
    assert {(r.hot, r.placement_key) for r in got} == {(r.hot, r.placement_key) for r in sharding.spread(df, "key", 10, "hot", salts=3).collect()}
    assert sharding.spread(df.limit(0), "key", 10, "hot").count() == 0


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(2000).select(F.lit("hot").alias("source"), F.col("id").alias("_file"), F.lit("long text " * 50_000).substr(1, 100).alias("text"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # which joins tasks as small as these
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        sharding.write_shards(df, "source", str(tmp_path / "out"), sharding.shard_names(4), files_per_shard=4)
    finally:
        spark.conf.set(coalesce, before)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000 and back.select("shard").distinct().count() == 1 and set(back.columns) == {"source", "_file", "text", "shard"}
    assert back.select(F.input_file_name()).distinct().count() > 1


def test_very_long_and_repeated_keys_are_placed(spark):
    long = "k" * 3_000_000
    got = sharding.place(spark.createDataFrame([(long,), (long,), ("",), (None,)], "key string"), "key").collect()
    assert len({(r.slot, r.shard) for r in got if r.key == long}) == 1 and len({r.slot for r in got if not r.key}) == 1
