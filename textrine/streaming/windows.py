"""The sliding window and its trees as a Structured Streaming query.

Chunks (doc_id, seq, chunk) arrive in files; the only order is ``seq``, from 0. State
per document is the text from the next window's begin on, how much was read, the
next chunk's number and the chunks that came early. The text in it is shorter than a
window plus a block; early chunks are bounded by ``waiting`` (below). A window is
emitted at each block boundary once the active part is full, as its text
(``window_stream``) or as the counts of its tree (``tree_stream``).

The end of a document: ``last_windows`` reads the state of a stream that has stopped
and gives each document's last window, which is not a whole number of blocks or not
full; a stream that never stops takes ``idle`` milliseconds without a chunk for the
end, emits the last window and forgets the document.

Defined results: a null or empty chunk adds nothing. A chunk whose number was
passed already is a repeat and has no influence. More than ``waiting`` chunks that
wait for an earlier one give up that one, as does the end of the document: the text goes
on with the least chunk there is. A document without a character has no window. Rows
with a null id or number are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "tail string, consumed long, next_seq long, waiting array<struct<seq: long, chunk: string>>"
PLACE = "doc_id long, window_no int, win_begin long, win_end long, is_full boolean"
SNAPSHOT = f"{PLACE}, buffer string"
COUNTS = f"{PLACE}, branching_nodes long, leaves long, edges long"

#: Chunks of a document that may wait for an earlier one, and characters that are read at once.
WAITING, STEP = 100_000, 1 << 20


def advance(tail: str, consumed: int, chunk: str, block: int, active: int):
    """Add a chunk: (tail, consumed, text from the first new window on, (no, begin, end) of the new windows).

    ``consumed`` characters were read; the tail begins where the next window does.
    """
    size = block * active
    text, before = tail + chunk, consumed - len(tail)
    consumed += len(chunk)
    first, after = before // block, max(0, (consumed - size) // block + 1)
    new = [(no, no * block + 1, no * block + size) for no in range(first, after)]
    return text[(max(after, first) - first) * block :], consumed, text, new


def last_window(tail: str, consumed: int, block: int, active: int):
    """(no, begin, end) of a document's last window, if the windows so far leave one."""
    size = block * active
    if consumed and (consumed < size or (consumed - size) % block):
        before = consumed - len(tail)
        return before // block, before + 1, consumed
    return None


def tree_counts(texts: list[str], size: int) -> list[tuple]:
    """(branching nodes, leaves) of every window of ``size`` characters of each text, by one sweep over all."""
    from textrine.operators.windows import counted
    from textrine.plans.sweep import swept

    return counted(swept, texts, size)


def with_text(doc_id: int, text: str, places: list[tuple], block: int, active: int) -> pd.DataFrame:
    """Windows as their text; ``text`` begins where the first of ``places`` does."""
    size = block * active
    rows = [(doc_id, *p, True, text[k * block : k * block + size]) for k, p in enumerate(places)]
    return pd.DataFrame(rows, columns=["doc_id", "window_no", "win_begin", "win_end", "is_full", "buffer"])


def with_counts(doc_id: int, text: str, places: list[tuple], block: int, active: int) -> pd.DataFrame:
    """Windows as the counts of their trees, all from one tree of ``text``."""
    out = pd.DataFrame(places, columns=["window_no", "win_begin", "win_end"])
    nodes, leaves = (x[::block][: len(places)] for x in tree_counts([text], block * active)[0])
    return out.assign(doc_id=doc_id, is_full=True, branching_nodes=nodes, leaves=leaves, edges=nodes - 1 + leaves)[[c.split()[0] for c in COUNTS.split(", ")]]


def stepper(block: int, active: int, emit: Callable, waiting: int, idle: int):
    """What one micro-batch does with one document."""

    def step(key, batches, state):
        tail, consumed, next_seq, early = state.get if state.exists else ("", 0, 0, [])
        held = {int(r["seq"] if isinstance(r, dict) else r[0]): (r["chunk"] if isinstance(r, dict) else r[1]) for r in early}
        for batch in batches:
            held.update((s, c) for s, c in zip(batch["seq"].astype(int).tolist(), batch["chunk"]) if s >= next_seq)
        ended = state.hasTimedOut

        def ready():
            """Chunks in order, as long as none is missing or the missing one is given up."""
            nonlocal next_seq
            for seq in sorted(held):
                if seq != next_seq and not ended and len(held) <= waiting:
                    return
                next_seq = seq + 1
                yield held.pop(seq) or ""

        some, length = [], 0
        chunks = ready()
        while True:
            chunk = next(chunks, None)
            if chunk is not None:
                some.append(chunk)
                length += len(chunk)
            if some and (chunk is None or length >= STEP):
                tail, consumed, text, new = advance(tail, consumed, "".join(some), block, active)
                some, length = [], 0
                if new:
                    yield emit(key[0], text, new, block, active)
            if chunk is None:
                break
        if ended:
            place = last_window(tail, consumed, block, active)
            if place:
                yield emit(key[0], tail, [place], block, active).assign(is_full=consumed >= block * active)
            state.remove()
            return
        state.update((tail, consumed, next_seq, [{"seq": s, "chunk": c} for s, c in sorted(held.items())]))
        if idle:
            state.setTimeoutDuration(idle)

    return step


def _stream(chunks: DataFrame, block: int, active: int, emit: Callable, schema: str, waiting: int, idle: int) -> DataFrame:
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = chunks.where("doc_id IS NOT NULL AND seq IS NOT NULL").groupBy("doc_id")
    return rows.applyInPandasWithState(stepper(block, active, emit, waiting, idle), schema, STATE, "append", timeout)


def window_stream(chunks: DataFrame, block: int, active: int, waiting: int = WAITING, idle: int = 0) -> DataFrame:
    """Windows of a stream of chunks with their text, keyed by document."""
    return _stream(chunks, block, active, with_text, SNAPSHOT, waiting, idle)


def tree_stream(chunks: DataFrame, block: int, active: int, waiting: int = WAITING, idle: int = 0) -> DataFrame:
    """Branching nodes, leaves and edges of the tree of each window of a stream of chunks.

    A micro-batch's characters join the text in the state, and one sweep over the tree of
    these counts all new windows; what is kept is less than a window and a block, whatever
    was read. Work is that of the new characters and one window.
    """
    return _stream(chunks, block, active, with_counts, COUNTS, waiting, idle)


def last_windows(spark: SparkSession, checkpoint: str, block: int, active: int, trees: bool = False) -> DataFrame:
    """The last window of each document of a stopped stream, from its state in ``checkpoint``.

    Each partition of the state is read where it lies. Early chunks that still wait follow
    the text, in order, without what is missing between; windows that they fill are given too.
    """
    kept = spark.read.format("statestore").load(checkpoint)
    rows = kept.select(F.col("key.doc_id").alias("doc_id"), "value.groupState.*")
    size = block * active
    emit, schema = (with_counts, COUNTS) if trees else (with_text, SNAPSHOT)

    def finish(batches):
        for batch in batches:
            for doc_id, tail, consumed, early in zip(batch["doc_id"], batch["tail"], batch["consumed"], batch["waiting"]):
                for chunk in sorted(early, key=lambda r: r["seq"]):
                    tail, consumed, text, new = advance(tail, consumed, chunk["chunk"] or "", block, active)
                    if new:
                        yield emit(doc_id, text, new, block, active)
                place = last_window(tail, consumed, block, active)
                if place:
                    yield emit(doc_id, tail, [place], block, active).assign(is_full=consumed >= size)

    return rows.select("doc_id", "tail", "consumed", "waiting").mapInPandas(finish, schema)


def run_available(spark: SparkSession, chunks: DataFrame, block: int, active: int, trees: bool = False, last: bool = True) -> DataFrame:
    """Run the stream over all files there are now; windows (or the counts of their trees) as a table.

    With ``last``, the files are all there will be, and each document's last window follows.
    Results and checkpoints go to the shared folder that the cluster names.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints/textrine"
    root = f"{base.rstrip('/')}/textrine-stream-{uuid.uuid4().hex[:12]}"
    stream = (tree_stream if trees else window_stream)(chunks, block, active)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(COUNTS if trees else SNAPSHOT).parquet(f"{root}/out")
    return found.unionByName(last_windows(spark, f"{root}/state", block, active, trees)) if last else found


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks, read as a stream of files."""
    schema = "conv_id long, turn long, role string, text string"
    path = f"{sf_dir}/[c]onversations.parquet"  # as a pattern, it may be one file or a folder of files
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    return stream.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))
