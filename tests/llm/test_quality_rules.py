import re

import numpy as np

from gridledger.llm import quality_rules as Q
from tests.llm.helpers import AWKWARD, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The contract's counts, word for word."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 3000 else {w for w, n in zip(*np.unique([" ".join(w) for w in windows], return_counts=True)) if n > 1}
    hit = {i + k for i, w in enumerate(windows) for k in range(3) if (w in twice or " ".join(w) in twice)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_over_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op12_quality_rules(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n, chars, symbols, lines, repeats = want = plain(text)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (got[i].base_failed and got[i].kept)


def test_verdicts_part_good_from_bad(spark):
    at = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in Q.op12_quality_rules(spark, at).collect() if r.doc_id in quality and not r.base_failed]
    share = lambda q: np.mean([r.kept for r in rows if quality[r.doc_id] == q])
    assert share(1) >= 0.995 and share(0) <= 0.05
    rest = [r for r in Q.op12_quality_rules(spark, at).collect() if r.doc_id not in quality and not r.base_failed]
    assert 0.85 < np.mean([r.kept for r in rest]) < 1  # most of the unlabelled are like the good ones


def path_of(forest, t, row):
    node = 0
    while forest.column[t, node] >= 0:
        node = 2 * node + 1 + (row[forest.column[t, node]] > forest.cut[t, node])
    return forest.path[t, node]


def test_paths_and_scores():
    rows = np.random.default_rng(1).normal(size=(500, 3))
    rows[:, 1] = 0  # a constant column is never split on
    forest = Q.Forest.grown(rows, trees=20, tree_rows=64, depth=6)
    assert 1 not in forest.column and (forest.column[:, 63:] == -1).all()
    far = np.vstack([rows[:50], [[9, 0, 9]]])
    want = [2 ** -(np.mean([path_of(forest, t, r) for t in range(20)]) / Q.mean_path(64)) for r in far]
    assert np.allclose(forest.scores(far), want) and forest.scores(far).argmax() == 50
    again = Q.Forest.grown(rows, trees=20, tree_rows=64, depth=6)
    assert (again.cut == forest.cut).all()
    alone = Q.Forest.grown(rows[:1])
    assert (alone.scores(rows) == alone.scores(rows)[0]).all()


def test_calibration(spark):
    scores = spark.createDataFrame([(i, i / 1000, i < 5) for i in range(1000)], "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(i, i < 900 or i == 998) for i in range(1000)], "doc_id long, good boolean")
    at = Q.calibrated(scores, labels)
    assert 0.898 < at <= 0.901  # one of 896 good documents is lost, all bad ones go
    assert Q.calibrated(scores, labels, lost=0.0) > 0.998
    for only in ("good", "NOT good"):
        assert Q.calibrated(scores, labels.filter(only)) == float("inf")


def test_awkward(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (5, 1, None), (None, 1, 1), (77, 0, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        got = Q.judged(docs(spark, AWKWARD), marks).collect()
        assert len(got) == len(AWKWARD) and [r.kept for r in got if r.doc_id != 5] == [False] * (len(AWKWARD) - 1)
        long = next(r for r in got if r.doc_id == 5)
        assert (long.n_words, long.n_repeat_words, long.base_failed) == (20000, 20000, True)
    assert Q.judged(docs(spark, []), labels).count() == 0
    assert Q.counts_of(None) == Q.counts_of("") == (0,) * 7
    assert Q.counts_of("a b\u00a0c \n a b\u00a0c\n a b\u00a0c\n\n")[:5] == (6, 12, 0, 1, 6)
    assert Q.repeated_words("a a a a".encode().split()) == 4 and Q.repeated_words("a b a b".encode().split()) == 0
