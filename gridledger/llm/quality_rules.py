"""Quality rules: statistics of every text, rules over them, and an isolation forest that finds the rest.

A row's statistics are counts over its whole text. A rule of two of them fails documents outright. For all
others an isolation forest looks at ratios of these counts (`FEATURES`): each tree splits a few rows at random
places until they stand alone, so that a row which stands alone after few splits is unlike the others. Trees
are grown on `TREE_ROWS` rows each, drawn from at most `SAMPLE` labelled documents, good and bad (those of the
smallest hash of doc_id); mean path lengths give scores between 0 and 1. The score above which a document goes
is calibrated on all labelled rows that pass the rules: of the scores that lose at most `LOST` of the good ones
it is that which best parts bad from good. Statistics, scores and counts for calibration cover all rows. Length
and repetition are left to the rules: good documents differ in them more than bad ones do.

Defined results: a null text has no words, lines or symbols, so it fails the rules, like any text of fewer than
50 words; tied scores fare alike; repeated rows each get a row; a document labelled twice is good only if all
its labels are; without a good label, or without a bad one, there is no verdict and the rules alone decide; an
empty table gives no rows; null doc_ids have no label; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common

SYMBOLS = "#*$%&|<>"
#: White space that parts words.
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Of a hundred words, how many may stand in windows that occur twice.
MOST_REPEATED = 50
TREES, TREE_ROWS, DEPTH = 128, 256, 8
#: Most labelled documents that trees are grown on.
SAMPLE = 8192
#: Of the documents labelled good, how many calibration may lose.
LOST = 0.005
#: Scores are told apart in this many steps where they are counted.
STEPS = 1 << 12
SEED = 12

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_marks")
MARKS = ".,;:!?"
#: What trees split on.
FEATURES = ("word_length", "symbols", "upper", "marks")


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    inside = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter((found[w] > 1 for w in windows), bool, len(windows)))
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def counts_of(text: str | None) -> tuple:
    """COUNTS and MORE of a text."""
    if not text:
        return (0,) * (len(COUNTS) + len(MORE))
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes, split() takes ASCII white space only
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    marks = sum(text.count(c) for c in MARKS)
    upper = sum(map(str.isupper, text))
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), upper, marks


def _counted(batches):
    for batch in batches:
        for part in common.pieces_of(batch):
            rows = [counts_of(t) for t in part.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[]] * (len(COUNTS) + len(MORE))
            yield pa.record_batch([part.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *COUNTS, *MORE])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row's text, with base_failed by the rules."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    counts = common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _counted, schema)
    return counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def features() -> list[Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return [share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbols"), share("n_upper", "word_chars").alias("upper"), share("n_marks", "n_words").alias("marks")]


def mean_path(n) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows: what a leaf of n rows still adds."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


class Forest:
    """Trees in heap order: `column` (-1 at a leaf), `cut`, and `path`, the length that a leaf stands for."""

    def __init__(self, column, cut, path, norm):
        self.column, self.cut, self.path, self.norm = column, cut, path, norm

    @classmethod
    def grown(cls, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rnd, size = np.random.default_rng(seed), (1 << (depth + 1)) - 1
        column, cut, path = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
        take = min(tree_rows, len(rows))
        for t in range(trees):
            held = {0: rows[rnd.choice(len(rows), take, replace=False)]}
            for node in range(size):
                if (x := held.pop(node, None)) is None:
                    continue
                level = (node + 1).bit_length() - 1
                low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(0), np.zeros(0))
                wide = np.flatnonzero(low < high)
                if level == depth or len(x) < 2 or not len(wide):
                    path[t, node] = level + mean_path(len(x))
                    continue
                c = column[t, node] = rnd.choice(wide)
                cut[t, node] = rnd.uniform(low[c], high[c])
                right = x[:, c] > cut[t, node]
                held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
        return cls(column, cut, path, mean_path(take) or 1.0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the fewer splits set a row apart."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for column, cut, path in zip(self.column, self.cut, self.path):
            at = np.zeros(len(rows), np.int64)
            while (going := (c := column[at]) >= 0).any():
                right = rows[every, np.maximum(c, 0)] > cut[at]
                at = np.where(going, 2 * at + 1 + right, at)
            total += path[at]
        return np.exp2(-total / len(self.column) / self.norm)


def fitted(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """A forest of labelled documents; None if there are none. labels: doc_id."""
    known = stats.join(labels.select("doc_id"), "doc_id", "left_semi")
    drawn = known.select("doc_id", *features()).orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), *FEATURES).limit(sample).collect()
    return Forest.grown(np.array([tuple(r)[1:] for r in drawn], float)) if drawn else None


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with score."""
    names = stats.columns

    def run(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(len(names) + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))])
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(forest.scores(rows))], names=[*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return common.arrow_map(stats.select("*", *features()), run, f"{kinds}, score double")


def calibrated(scores: DataFrame, labels: DataFrame, lost: float = LOST) -> float:
    """The score above which a document goes, from all labelled ones that pass the rules; infinite without both kinds.

    Scores are counted in STEPS steps, so what reaches the driver is bounded. labels: doc_id, good."""
    known = scores.filter(~F.col("base_failed")).join(labels, "doc_id").groupBy(F.floor(F.col("score") * STEPS).alias("step"), "good").agg(F.count("*").alias("n"))
    good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    for r in known.collect():
        (good if r.good else bad)[r.step] = r.n
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda x: (x.sum() - np.cumsum(x)) / x.sum()  # noqa: E731  share of those in higher steps
    gain = np.where(above(good) <= lost, above(bad) - above(good), -1.0)
    return (int(gain.argmax()) + 1) / STEPS


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its counts, base_failed, score (null without a forest) and kept. labels: doc_id, quality."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    stats = common.settle(statistics(docs), "quality-counts")
    forest = fitted(stats, marks)
    if forest is None:
        return stats.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    scores = common.settle(scored(stats, forest), "quality-scores")
    common.discard(stats)
    limit = calibrated(scores, marks)
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(limit)))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the rules and the forest, with labels from `labels`."""
    out = judged(common.docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
