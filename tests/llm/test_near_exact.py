"""No near copies are missed: the pipeline's stage against plain counts of shared shingles."""

from collections import Counter, defaultdict

import numpy as np

from gridledger.llm import near_copies as N
from tests.llm.test_near_copies import corpus, docs, sets_of, stage, staying


def staying_of_many(texts):
    """As staying, with the texts that share a shingle by an index of all of them."""
    up, where = {i: i for i in texts}, defaultdict(list)
    sets = {i: sets_of(t) for i, t in texts.items()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(texts):
        for j, both in Counter(j for s in sets[i] for j in where[s]).items():
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
        for s in sets[i]:
            where[s].append(i)
    return {i for i in texts if top(i) == i}


def test_none_is_missed_in_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {}
    for r in d.select("doc_id", "text").orderBy("doc_id").collect():
        texts.setdefault(r.text or "", r.doc_id)
    want = staying_of_many({i: t for t, i in texts.items()})
    assert {r.doc_id for r in stage(spark, d).select("doc_id").collect()} == want


def test_none_is_missed_in_chains_and_groups(spark):
    texts = corpus()
    assert {r.doc_id for r in stage(spark, docs(spark, list(texts.items()))).collect()} == staying(texts)


def test_what_cannot_be_left_out():
    """A pair that is alike passes the bounds of sizes, places and parities, whatever it shares; others may go."""
    rnd, none = np.random.default_rng(5), np.array([], np.uint64)
    kept = 0
    for _ in range(300):
        base = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 80)).astype(np.uint64))
        a = base[rnd.random(len(base)) < 0.93]
        b = np.union1d(base[rnd.random(len(base)) < 0.93], rnd.integers(0, 1 << 63, rnd.integers(0, 4)).astype(np.uint64))
        if not len(a) or not len(b) or not N.alike(a, b):
            continue
        first = [np.concatenate(N.ordered(s, none, none))[: N.first_shingles(len(s))].tolist() for s in (a, b)]
        shared = set(first[0]) & set(first[1])
        assert shared
        for s in shared:
            x, _ = N._possible(np.array([0]), np.array([1]), np.array([len(a), len(b)]), [f.index(s) for f in first], [N.parity(a), N.parity(b)], [1, 2])
            kept += len(x)
            assert len(x)
    assert kept
