import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from gridledger.llm import near_copies as N
from tests.llm.helpers import AWKWARD, docs


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def staying(texts):
    """The smallest id of each group: components of all pairs of similarity 0.8 or more, by brute force."""
    ids, sets = sorted(texts), {i: sets_of(t) for i, t in texts.items()}
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i for i in ids if top(i) == i}


def stage(spark, d):
    return dict(P.STAGES)["SimHash near-dedup"](spark, d, "")


def test_stage_on_the_given_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in d.collect()}
    assert {r.doc_id: r for r in stage(spark, d).collect()} == {i: rows[i] for i in staying({i: r.text for i, r in rows.items()})}


def edited(rnd, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return out


def corpus():
    """Chains of edits, a large group, a passage that most texts hold, texts of few words."""
    rnd, texts = random.Random(3), []
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(40)]
    for _ in range(30):
        t = [word() for _ in range(rnd.choice((12, 60, 150)))]
        for _ in range(4):
            texts.append(t)
            t = edited(rnd, t, rnd.randrange(1, 4))
    base = [word() for _ in range(120)]
    texts += [edited(rnd, base, rnd.randrange(0, 3)) for _ in range(60)]
    texts += [passage + [word() for _ in range(rnd.randrange(2, 40))] for _ in range(80)]
    texts += [[word() for _ in range(rnd.randrange(1, 8))] for _ in range(20)]
    rnd.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_stage_against_brute_force(spark):
    """No other document is dropped; of those that should go, in a corpus of chains and one passage, nearly all do."""
    texts = corpus()
    got = [r.doc_id for r in stage(spark, docs(spark, list(texts.items()))).collect()]
    want = staying(texts)
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(set(got) - want) <= 0.05 * (len(texts) - len(want))


def test_shared_rows_over_any_batches():
    """Each row meets the first row of its shingle and the one before, wherever batches end."""
    rnd = random.Random(1)
    rows = sorted({(rnd.randrange(30), rnd.randrange(12), 7) for _ in range(90)})
    want = set()
    for k, (h, node, _) in enumerate(rows):
        own = [x for g, x, _ in rows[:k] if g == h]
        want |= {(min(x, node), max(x, node), 7, 7) for x in own[:1] + own[-1:]}
    for step in (1, 2, 3, 7, 90):
        batches = [pa.record_batch([pa.array(np.array(c)) for c in zip(*rows[k : k + step])], names=["h", "node", "size"]) for k in range(0, len(rows), step)]
        assert {tuple(r.values()) for b in N._shared(iter(batches)) for r in b.to_pylist()} == want


def test_awkward(spark):
    d = docs(spark, AWKWARD)
    left = stage(spark, d)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "5", "6", "None"]
    assert stage(spark, docs(spark, [])).count() == 0


def test_awkward(spark):
    d = docs(spark, AWKWARD)
    left = N.drop_near_copies(d)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {1, 3, 5, 6, None}


def test_all_that_share_a_shingle_meet(spark):
    rnd = random.Random(3)
    rows = [(h, node, 10 + node % 7) for h in range(4) for node in rnd.sample(range(-30, 30), 40 if h else 1)]
    first = spark.createDataFrame(rows, "h long, node long, size int")
    want = {(a, b) for h, a, _ in rows for g, b, _ in rows if g == h and a < b}
    for block in (1, 7, 256):
        got = N.all_shared(first, block).collect()
        assert {(r.a, r.b) for r in got} == want and all({r.least, r.most} == {10 + r.a % 7, 10 + r.b % 7} for r in got)


def test_recall(spark):
    """Of the texts that the exact way drops, the default drops nine tenths at least, and no others; both over all of sf0.1."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").dropDuplicates(["text"])
    left = {r.doc_id for r in N.drop_near_copies(d).select("doc_id").collect()}
    exact = {r.doc_id for r in N.drop_near_copies(d, exact=True).select("doc_id").collect()}
    every = {r.doc_id for r in d.select("doc_id").collect()}
    assert len(every - left) >= 0.9 * len(every - exact) > 0


def test_exact_over_a_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {}
    for r in d.orderBy("doc_id").collect():
        texts.setdefault(r.text, r.doc_id)
    want = staying({i: t for t, i in texts.items()})
    assert {r.doc_id for r in N.drop_near_copies(d, exact=True).collect()} == want
