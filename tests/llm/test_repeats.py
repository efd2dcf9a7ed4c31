import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridledger.llm import repeats as R
from tests.llm.helpers import AWKWARD, docs


def slow(texts, window):
    seen = Counter(b[k : k + window] for b in texts for k in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def held(spark, texts, **how):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.dedup_passages(docs(spark, list(enumerate(texts))), **how).collect()}
    assert [got[i] for i in range(len(texts))] == slow([(t or "").encode() for t in texts], how.get("window", 200))


def test_planted(spark):
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    shared, other = text(300), text(260)
    texts = [text(150) + shared + text(80), shared[20:260] + text(90), text(400), other + text(10) + other, "ab" * 300, "x" * 450, shared, text(199), None, ""]
    held(spark, texts)
    held(spark, texts, hot_segments=0)
    held(spark, texts, hot_segments=2)
    held(spark, texts, window=400)  # over 287 bytes
    assert not [t for t in spark.catalog.listTables() if "repeat" in t.name]


def test_common_passage(spark):
    """Every text holds one passage between bytes of its own: anchors at its edges have many different segments."""
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = text(420)
    texts = [text(rnd.randrange(300)) + passage[rnd.randrange(60) :] + text(rnd.randrange(300)) for _ in range(60)]
    for hot in (8000, 20, 1):
        held(spark, texts, hot_segments=hot)


def test_finer_segments():
    """Each window of a segment is in one part; windows that are equal are in parts of one name."""
    rnd = random.Random(6)
    for width in (1, 5, 12, 200):
        for _ in range(50):
            at = rnd.randrange(0, 168)
            last = rnd.randrange(0, at + 1)
            segment = bytes(rnd.randrange(256) for _ in range(at - last + 200))
            parts = list(R.finer(9, at, segment, width, 200, 32))
            windows = [b + k for b, _, _, s in parts for k in range(len(s) - 199)]
            assert sorted(windows) == list(range(len(segment) - 199))
            assert all(segment[b : b + len(s)] == s and b + p == at for b, _, p, s in parts)
            begin, name, place, piece = rnd.choice(parts)
            more = b"?" * 3 + segment[begin : begin + 200]
            assert name in {n for _, n, _, _ in R.finer(9, place + 3, more, width, 200, 32)}


def test_windows_that_are_too_long(spark):
    with pytest.raises(ValueError):
        R.dedup_passages(docs(spark, [(1, "x")]), window=1 << 16)


def test_small_window(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    held(spark, texts, window=12, gram=4)
    held(spark, texts, window=12, gram=4, hot_segments=1)


def test_suffix_array():
    parts = [b"banana", b"bandana", b"ana", b"\x00\xff\x00\xff"]
    array = R.SuffixArray(parts, 1)
    suffix = lambda p: bytes(int(x) - 1 for x in array.sym[p : p + array.rest[p]])
    order = [suffix(p) for p in array.order]
    assert order == sorted(order)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert array.prefix.tolist() == [common(a, b) for a, b in zip(order, order[1:])]
    found = {suffix(int(s[0]))[:n]: len(s) for n, s in array.maximal_repeats(2)}
    assert found[b"ana"] == 4 and found[b"ban"] == 2 and b"\x00\xff" in found and b"nan" not in found


def test_awkward(spark):
    got = R.dedup_passages(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.n_removed == r.n_bytes for r in got if r.doc_id == 5} == {True}  # it repeats itself
    assert R.dedup_passages(docs(spark, [])).count() == 0
