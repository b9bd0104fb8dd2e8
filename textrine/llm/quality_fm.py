"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
the sum-of-squares identity makes all pairwise interactions linear in the
number of set features. Words (ASCII-folded, whole text) are hashed into
``BUCKETS`` and weighted by length-normalised counts; structure statistics and
the text's size are standardised dense features.

The model is fitted on at most ``FIT_ROWS`` labelled rows, none of which is
held out (crc32 of the id as text, mod 4, is 2). Every row is scored.

Defined results: null texts score as empty ones, from bias and structure
alone; without labels of both classes all rows score the prior (0.5 without
any); repeated rows score alike; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import CACHE_WORDS, WordHashes, text_slices
from textrine.llm.quality_rules import rule_counts

FIT_ROWS = 8_000
BUCKETS, RANK, EPOCHS, BATCH, SEED = 1 << 13, 8, 8, 128, 5
RATE, DECAY = 0.02, 1e-4
#: Steps at least, where the labelled rows are few.
STEPS = 250
CUT = 0.7


class Buckets(dict):
    """word (bytes) -> bucket of its folded form."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        b = xxhash.xxh3_64_intdigest(word.lower(), 3) % BUCKETS
        if len(word) <= 64:
            self[word] = b
        return b


def structure(text: str | None, cache: WordHashes) -> list[float]:
    """Dense features: rates of the rule counts, and sizes as logarithms."""
    words, word_chars, symbols, dup, repeat, chars, lines, upper, digits, bangs, distinct, echoes = rule_counts(text, cache)
    w, c = max(words, 1), max(chars, 1)
    return [
        np.log1p(words), np.log1p(chars), word_chars / w, min(symbols / w, 4.0), dup / max(lines, 1), repeat / w,
        upper / c, digits / c, min(bangs / w, 4.0), distinct / w, np.log1p(w / max(lines, 1)), echoes / w,
    ]


def vectors(texts, buckets: Buckets, cache: WordHashes):
    """Sparse word vectors of some texts as (owner, bucket, value), and dense ones."""
    look = buckets.__getitem__
    lists = [list(map(look, (t or "").encode("utf-8", "surrogatepass").split())) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    owner = np.repeat(np.arange(len(lists)), counts)
    flat = np.concatenate([np.array(x, np.int64) for x in lists]) if len(owner) else np.zeros(0, np.int64)
    key, n = np.unique(owner * BUCKETS + flat, return_counts=True)
    owner, flat = key // BUCKETS, key % BUCKETS
    value = np.sqrt(n)
    norm = np.sqrt(np.bincount(owner, value**2, len(lists)))
    return owner, flat, value / np.maximum(norm[owner], 1e-9), np.array([structure(t, cache) for t in texts]).reshape(len(lists), -1)


class FactorisationMachine:
    """Parameters for BUCKETS sparse features followed by the dense ones."""

    def __init__(self, dense: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(BUCKETS + dense)
        self.v = rng.normal(0, 0.05, (BUCKETS + dense, RANK))
        self.mean, self.scale = np.zeros(dense), np.ones(dense)

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -6, 6)

    def logits(self, n: int, owner, bucket, value, dense) -> np.ndarray:
        """Linear time in the set features, by the sum-of-squares identity."""
        z = self.standard(dense)
        wd, vd = self.w[BUCKETS:], self.v[BUCKETS:]
        out = self.w0 + np.bincount(owner, self.w[bucket] * value, n) + z @ wd
        for f in range(RANK):
            t = self.v[bucket, f] * value
            total = np.bincount(owner, t, n) + z @ vd[:, f]
            squares = np.bincount(owner, t * t, n) + (z**2) @ (vd[:, f] ** 2)
            out += 0.5 * (total**2 - squares)
        return out

    def fit(self, x: np.ndarray, dense: np.ndarray, y: np.ndarray) -> None:
        """Adam on the logistic loss; x is a dense float32 block of word values."""
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        self.w0 = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        z = self.standard(dense).astype(np.float32)
        rng = np.random.default_rng(SEED)
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        m = {k: 0.0 for k in "0wv"}
        s = {k: 0.0 for k in "0wv"}
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(y)))):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                rows = np.sort(order[i : i + BATCH])
                xb = np.hstack([x[rows], z[rows]])
                sums = xb @ self.v
                sq = xb**2
                logit = self.w0 + xb @ self.w + np.float32(0.5) * (sums**2 - sq @ self.v**2).sum(1)
                g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
                g = g.astype(np.float32)
                grad = {
                    "0": g.sum(),
                    "w": xb.T @ g + np.float32(DECAY) * self.w,
                    "v": xb.T @ (g[:, None] * sums) - (sq.T @ g)[:, None] * self.v + np.float32(DECAY) * self.v,
                }
                step += 1
                for k, d in grad.items():
                    m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * d
                    s[k] = np.float32(0.999) * s[k] + np.float32(0.001) * d * d
                    move = np.float32(RATE / (1 - 0.9**step)) * m[k] / (np.sqrt(s[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
                    if k == "0":
                        self.w0 -= float(move)
                    elif k == "w":
                        self.w -= move
                    else:
                        self.v -= move


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS):
    """Word vectors, dense features and labels of at most ``limit`` rows.

    The ids are chosen from the labels alone, by hash; their list is bounded
    and is what the documents are filtered with, so that no text is shuffled.
    A bound on the hash, from a count, leaves little more than ``limit`` ids
    before any are sent. Of an id with several rows, the one whose text has the
    least hash is taken, in the tasks that read them.
    """
    import pyarrow as pa

    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, (1.1 * limit + 1000) / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * share) + 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    wanted = {r.doc_id: r.quality for r in chosen.collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(wanted.items()) or [(-1, 0)], "doc_id long, quality int")

    def take(batches):
        buckets, cache = Buckets(), WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, bucket, value, dense = vectors(batch.column(1).to_pylist(), buckets, cache)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                batch.column(2),
                pa.array([bucket[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32())),
                pa.array([value[a:b].astype(np.float32) for a, b in zip(cuts, cuts[1:])], pa.list_(pa.float32())),
                pa.array(list(dense), pa.list_(pa.float64())),
            ], ["doc_id", "th", "bucket", "value", "dense"])

    picked = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    made = picked.mapInArrow(take, "doc_id long, th long, bucket array<int>, value array<float>, dense array<double>")
    rows = made.groupBy("doc_id").agg(F.min_by(F.struct("bucket", "value", "dense"), "th").alias("x")).select("doc_id", "x.*").toArrow()
    got = sorted(zip(rows["doc_id"].to_pylist(), range(rows.num_rows)))[:limit]
    x = np.zeros((len(got), BUCKETS), np.float32)
    dense = np.zeros((len(got), len(structure("", WordHashes()))))
    y = np.zeros(len(got))
    bucket, value, flat = rows["bucket"].combine_chunks(), rows["value"].combine_chunks(), rows["dense"].to_pylist()
    for k, (doc_id, i) in enumerate(got):
        x[k, np.asarray(bucket[i].values)] = np.asarray(value[i].values)
        dense[k], y[k] = flat[i], wanted[doc_id]
    return x, dense, y


def fit(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    x, dense, y = training_rows(docs, labels)
    model = FactorisationMachine(dense.shape[1])
    if len(y) and 0 < y.mean() < 1:
        model.fit(x, dense, y)
    else:
        model.v[:] = 0
        model.w0 = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return model


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; no shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + dense) x (RANK + 1) numbers: 0.6 MB

    def run(batches):
        buckets, cache, fm = Buckets(), WordHashes(), shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, texts in text_slices(batch.column(1), 2_000_000):
                out[a:b] = fm.logits(b - a, *vectors(texts, buckets, cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
