"""Quality rules with an isolation forest over rule statistics.

Every document gets rule statistics of its whole text. Two base rules reject
outright; the rest is judged by one isolation forest over all RATES. Each tree is
grown from some ordinary rows (labelled good): a node draws a statistic and a place
to cut it at random, until a row is alone, so that a short expected path marks a
rare row. Cuts are drawn from a range that reaches BEYOND the rows' own on both
sides; a row outside it in any statistic is then alone after few cuts, however
ordinary its others are, while rows inside keep long paths.

The forest is grown from at most FIT_ROWS rows labelled good of one half of the ids
(by a hash). Its threshold comes from the other half, from the scores of all rows
labelled good that pass the base rules: a row that is as ordinary as these is
rejected with an expected probability of CLEAN_LOSS at most. With fewer than
2 / CLEAN_LOSS of them this share is extrapolated from the mean excess of their
highest scores (an exponential tail). If nearly all rows labelled bad score higher
still, the threshold lies half-way between. A forest that finds a smaller share of
the rows labelled bad than of the good ones is not asked.

Defined results: null and empty texts have zero counts and fail the base rules;
repeated rows get equal verdicts; ties at a threshold are kept; with fewer than
FEWEST rows of good quality in either half the forest rejects nothing; where
labelled rows share an id one of them counts; extra columns pass through
``filter_documents`` untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrine.llm.common import Scratch, WordHashes, bitmap_of, give_back, in_bitmap, shingle_hashes, text_slices

#: Rows labelled good that the forest is grown from, at most (chosen by a hash of the id), and at least.
FIT_ROWS, FEWEST = 20_000, 8
TREES, SUBSAMPLE, SEED = 120, 256, 11
#: How far cuts reach beyond the rows of a node's tree, in widths of their range.
BEYOND = 3.0
#: Share of ordinary rows that the threshold may reject, and of bad ones that may lie under a threshold half-way to them.
CLEAN_LOSS, BAD_LOSS = 0.001, 0.01
BINS = 1 << 14
#: Bytes of text that a filtering task has as strings at once (and one text, if it is longer).
SLICE = 4 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars_seen", "n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct", "n_echoes"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)

SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
UPPER, DIGITS, BANGS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"


def rule_counts(text: str | None, cache: WordHashes) -> list[int]:
    """The counts of one whole text, in the order of COUNTS + MORE."""
    if not text:
        return [0] * (len(COUNTS) + len(MORE))
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hashes = np.array(list(map(cache.__getitem__, words)), np.uint64)
    windows = shingle_hashes(hashes, np.array([len(words)]), 5)[0] if len(words) >= 6 else hashes[:0]
    covered = 0
    if len(windows):
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.zeros(len(words), bool)
            at = np.flatnonzero(np.isin(windows, twice))
            for j in range(5):
                hit[at + j] = True
            covered = int(hit.sum())
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        len(words), len(text) - without(SPACES), sum(map(text.count, SYMBOLS)), dup, covered,
        len(text), len(lines), without(UPPER), without(DIGITS), without(BANGS), len(set(words)), int((hashes[1:] == hashes[:-1]).sum()),
    ]


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts per document; no shuffle, memory of one Arrow batch."""
    import pyarrow as pa

    def count(batches):
        cache = WordHashes()
        for batch in batches:
            rows = [rule_counts(t.as_py(), cache) for t in batch.column(1)]
            columns = np.array(rows, np.int64).reshape(len(rows), len(COUNTS + MORE)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", *COUNTS, *MORE])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(count, SCHEMA)


#: The statistics that the forest judges, and the least width of each one's range: less is no difference.
RATES = {"symbols": 0.05, "upper": 0.02, "digits": 0.05, "bangs": 0.05, "echoes": 0.05, "dup_lines": 0.1, "repeats": 0.05, "word_length": 1.0, "line_length": 1.0, "variety": 0.5}


def rates(x: pd.DataFrame) -> np.ndarray:
    """The RATES of some rows of counts.

    Each is damped by a few ordinary words, characters or lines, so that short
    texts are not outliers for their length.
    """
    words, chars, lines = x["n_words"].to_numpy(float) + 20, x["n_chars_seen"].to_numpy(float) + 80, x["n_lines"].to_numpy(float) + 2
    return np.column_stack([
        x["n_symbols"] / words, x["n_upper"] / chars, x["n_digits"] / chars, x["n_bangs"] / words, x["n_echoes"] / words,
        x["n_dup_lines"] / lines, x["n_repeat_words"] / words, (x["word_chars"] + 100) / words,
        np.log((x["n_words"] + 20) / lines), np.log((x["n_distinct"] + 20) / np.sqrt(words)),
    ]).astype(float)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random cuts over all statistics, as arrays of nodes: which statistic is cut where, the nodes below (-1 at leaves), and leaves' paths."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = min(subsample, len(rows))
        self.norm = float(mean_path(np.array([max(2, n)]))[0])
        self.limit = 2 * int(np.ceil(np.log2(max(2, n))))
        self.bound = 2.0
        nodes: list[list] = []
        self.roots = []
        for _ in range(trees):
            some = rows[rng.choice(len(rows), n, replace=False)]
            room = BEYOND * np.maximum(some.max(0) - some.min(0), list(RATES.values()))
            self.roots.append(self.grow(nodes, some, some.min(0) - room, some.max(0) + room, 0, rng))
        columns = list(zip(*nodes))
        self.which, self.left, self.right = (np.array(c, np.int32) for c in columns[:3])
        self.cuts, self.paths = np.array(columns[3], float), np.array(columns[4], float)

    def grow(self, nodes, rows, low, high, depth, rng) -> int:
        i = len(nodes)
        if depth >= self.limit or len(rows) <= 1:
            nodes.append([-1, -1, -1, 0.0, depth + float(mean_path(np.array([len(rows)]))[0])])
            return i
        k = int(rng.integers(rows.shape[1]))
        cut = float(rng.uniform(low[k], high[k]))
        nodes.append([k, -1, -1, cut, 0.0])
        under, top, bottom = rows[:, k] < cut, high.copy(), low.copy()
        top[k] = bottom[k] = cut
        nodes[i][1] = self.grow(nodes, rows[under], low, top, depth + 1, rng)
        nodes[i][2] = self.grow(nodes, rows[~under], bottom, high, depth + 1, rng)
        return i

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / normaliser): near 1 is anomalous, 0.5 and less ordinary."""
        total = np.zeros(len(rows))
        for root in self.roots:
            at, todo = np.full(len(rows), root), np.arange(len(rows))
            while len(todo := todo[self.which[at[todo]] >= 0]):
                here = at[todo]
                at[todo] = np.where(rows[todo, self.which[here]] < self.cuts[here], self.left[here], self.right[here])
            total += self.paths[at]
        return np.exp2(-total / len(self.roots) / self.norm)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def with_score(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` with the forest's score as ``anomaly`` (0 without a forest)."""
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(rates(pd.concat(columns, axis=1, keys=COUNTS + MORE))))

    return stats.withColumn("anomaly", score(*(F.col(c) for c in COUNTS + MORE)))


def fit_forest(good: DataFrame) -> IsolationForest | None:
    """A forest from at most FIT_ROWS rows, one for each id, chosen by a hash of the id.

    A bound on the hash, from a count, leaves little more than FIT_ROWS rows before any are sent.
    """
    one = good.groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *MORE)).alias("x")).select("doc_id", "x.*")
    n = one.count()
    some = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, (1.1 * FIT_ROWS + 1000) / max(n, 1))) + 1)
    rows = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select(*COUNTS, *MORE).toPandas()
    return IsolationForest(rates(rows)) if len(rows) >= FEWEST else None


def threshold(good: np.ndarray, bad: np.ndarray, grown: np.ndarray) -> float:
    """The bound on scores, from counts of the bins of [0, 1]: of held-out good rows, of bad ones, of those that the forest is grown from."""
    if good.sum() < FEWEST:
        return 2.0
    n = good.sum()
    above = np.cumsum(good[::-1])[::-1]  # in this bin or a higher one
    if n * CLEAN_LOSS >= 2:
        first = int(np.argmax(np.append(above, 0) <= CLEAN_LOSS * (n + 1)))
    else:  # too few for the share itself: as far beyond the highest twentieth as their mean excess tells
        start = int(np.flatnonzero(above >= max(FEWEST, n // 20))[-1])
        excess = np.arange(BINS + 1 - start) @ good[start:] / above[start]
        first = min(BINS, start + 1 + int(excess * np.log(above[start] / (n * CLEAN_LOSS))))
        if not bad.sum():  # nothing tells a labelled row from a bad one
            first = max(first, int(np.flatnonzero(good + grown)[-1]) + 1)
    if not bad.sum():
        return first / BINS
    low = int(np.argmax(np.cumsum(bad) > BAD_LOSS * bad.sum()))  # all but BAD_LOSS of the bad are in this bin or higher
    if low > first:
        return (first + low) / 2 / BINS
    useful = bad[first:].sum() * n > good[first:].sum() * bad.sum()
    return first / BINS if useful else 2.0


def calibrate(scored: DataFrame, forest: IsolationForest) -> None:
    """The forest's threshold, from histograms of all labelled rows: BINS counts for each ``part`` (0 bad, 1 good and held out, 2 good), whatever their number."""
    counted = scored.groupBy("part", F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.count("*").alias("n")).collect()
    bins = np.zeros((3, BINS + 1), np.int64)
    for r in counted:
        bins[r.part, r.bin] = r.n
    forest.bound = threshold(bins[1], bins[0], bins[2])


def qualities(labels: DataFrame) -> DataFrame:
    """One quality for each labelled id."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))


def fitted(stats: DataFrame, quality: DataFrame) -> IsolationForest | None:
    labelled = stats.join(quality, "doc_id").where("NOT base_failed AND quality IN (0, 1)")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    forest = fit_forest(labelled.where((half == 0) & (F.col("quality") == 1)))
    if forest:
        calibrate(with_score(labelled, forest).withColumn("part", F.when(F.col("quality") == 0, 0).otherwise(2 - half)), forest)
    return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and the anomaly score, for every document."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.keep(rule_statistics(docs), "stats").withColumn("base_failed", base_failed())
    forest = fitted(stats, qualities(labels))
    bound = forest.bound if forest else 2.0
    return with_score(stats, forest).select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") <= bound)).alias("kept"), "anomaly")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns.

    Labelled documents alone are counted for the fit; a bitmap of their ids tells
    which. The verdict is a function of the text, so that rows which share an id
    have each their own and no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    quality = qualities(labels)
    shared = bitmap_of(quality.withColumn("hash", F.xxhash64("doc_id")), "hash")

    @F.pandas_udf("boolean")
    def wanted(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, hashes.to_numpy(np.int64)))

    some = docs.where("doc_id IS NOT NULL").where(wanted(F.xxhash64(F.col("doc_id").cast("long"))))
    stats = scratch.keep(rule_statistics(some), "stats").withColumn("base_failed", base_failed())
    forest = fitted(stats, quality)
    shared.destroy()
    scratch.drop_all()

    @F.arrow_udf("boolean")
    def keeps(texts):
        import pyarrow as pa

        cache, out = WordHashes(), []
        for _, _, some in text_slices(texts, SLICE):
            x = pd.DataFrame([rule_counts(t, cache) for t in some], columns=COUNTS + MORE)
            failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
            out.append((~failed & (forest.score(rates(x)) <= forest.bound if forest else True)).to_numpy())
        del cache
        give_back()
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(keeps(F.coalesce(F.col("text"), F.lit(""))))
