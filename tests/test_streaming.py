"""Windows and window trees of streams against the batch forms."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textrine import queries
from textrine.operators import windows
from textrine.streaming import windows as streams

CHUNKS = "doc_id long, seq long, chunk string"
COLUMNS = ["doc_id", "window_no", "win_begin", "win_end", "is_full", "buffer"]


def texts(seed=3, docs=40, longest=40):
    r = random.Random(seed)
    return {k: "".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, longest))) for k in range(docs)}


def rows_of(df, columns=COLUMNS):
    return sorted(map(tuple, df.select(*columns).collect()))


def batch_counts(snaps):
    """Counts of each window's own tree, by the batch operator."""
    e = windows.window_edges(snaps)
    counts = e.groupBy("doc_id", "window_no").agg((1 + F.sum((F.col("leaf_start") == 0).cast("long"))).alias("branching_nodes"), F.sum((F.col("leaf_start") > 0).cast("long")).alias("leaves"), F.count("*").alias("edges"))
    return snaps.select(*COLUMNS[:5]).join(counts, ["doc_id", "window_no"])


COUNTED = [*COLUMNS[:5], "branching_nodes", "leaves", "edges"]


class State:
    """What a micro-batch is given as a document's state."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def update(self, x):
        self.get, self.exists = x, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def feed(step, state, *chunks):
    frame = pd.DataFrame(list(chunks), columns=["seq", "chunk"])
    return [tuple(r)[1:] for out in step((7,), iter([frame]), state) for r in out.itertuples(index=False)]


@pytest.mark.parametrize("block, active", [(4, 2), (1, 3), (7, 1), (50, 2)])
@pytest.mark.parametrize("piece", [1, 64, streams.STEP])
def test_any_cuts(monkeypatch, block, active, piece):
    monkeypatch.setattr(streams, "STEP", piece)
    t = "the quick brown fox jumps over the lazy dog"
    size = block * active
    want = [(k, k * block + 1, k * block + size, True, t[k * block : k * block + size]) for k in range((len(t) - size) // block + 1)]
    for cuts in ([5, 1, 30, 7], [43], [1] * 43, [0, 9, 0, 34]):
        state, got, at = State(), [], 0
        step = streams.stepper(block, active, streams.with_text, 100, 0)
        for k, c in enumerate(cuts):
            got += feed(step, state, (k, t[at : at + c]))
            at += c
            assert len(state.get[0]) < size + block
        assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [(d, k, t[4 * k : 4 * k + 4]) for d, t in texts().items() for k in range((len(t) + 3) // 4)]
    rows += [(None, 0, "lost"), (1, None, "lost"), (500, 0, ""), (501, 0, None), (2**60 + 1, 0, "ab"), (502, 1, "without a first chunk")]
    spark.createDataFrame(rows, CHUNKS).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = [*texts().items(), (2**60 + 1, "ab"), (502, "without a first chunk")]
    snaps = windows.snapshots(spark.createDataFrame(whole, "doc_id long, text string"), 3, 2)
    assert rows_of(streams.run_available(spark, stream, 3, 2)) == rows_of(snaps)
    without_last = streams.run_available(spark, stream, 3, 2, last=False)
    assert rows_of(without_last) == rows_of(snaps.where("win_len = 6 AND doc_id <> 502"))
    assert rows_of(streams.run_available(spark, stream, 3, 2, trees=True), COUNTED) == rows_of(batch_counts(snaps), COUNTED)


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], CHUNKS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
    for trees in (False, True):
        assert streams.run_available(spark, stream, 3, 2, trees).count() == 0


def test_early_repeated_and_lost_chunks():
    state, step = State(), streams.stepper(2, 1, streams.with_text, 2, 0)
    assert feed(step, state, (2, "ef"), (1, "cd")) == []
    assert feed(step, state, (0, "ab")) == [(0, 1, 2, True, "ab"), (1, 3, 4, True, "cd"), (2, 5, 6, True, "ef")]
    assert feed(step, state, (0, "xx"), (1, "yy")) == []  # repeats
    assert feed(step, state, (5, "kl"), (6, "mn")) == []
    assert feed(step, state, (7, "op")) == [(3, 7, 8, True, "kl"), (4, 9, 10, True, "mn"), (5, 11, 12, True, "op")]  # three wait: 3 and 4 are given up
    assert feed(step, state, (3, "gh")) == [] and state.get[3] == []


def test_idle_documents_end():
    for emit, want in ((streams.with_text, [(1, 3, 5, True, "cde")]), (streams.with_counts, [(1, 3, 5, True, 1, 3, 3)])):
        state, step = State(), streams.stepper(2, 2, emit, 100, 60_000)
        assert len(feed(step, state, (0, "abcd"), (2, "e"))) == 1 and state.timeout == 60_000
        state.hasTimedOut = True
        assert feed(step, state) == want and not state.exists  # chunk 1 never came
    state = State()
    feed(step, state, (0, "abcd"))
    state.hasTimedOut = True
    assert feed(step, state) == [] and not state.exists  # no window is left


def test_conversations(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
    whole = parts.select(F.col("conv_id").alias("doc_id"), F.array_join("p.t", "").alias("text"))
    want = rows_of(batch_counts(windows.snapshots(whole, 100, 10)), COUNTED)
    assert rows_of(queries.streaming_window_trees_1000(spark, sf), COUNTED) == want and want
