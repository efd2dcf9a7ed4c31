import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.llm import simhash as H
from gridledger.llm.components import components
from tests.llm.helpers import AWKWARD, docs


def slow(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\n\x0b Ü", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert H.fingerprint(text.encode()) == slow(text)


def groups_of(prints):
    ids, up = list(prints), {}
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_queries(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: slow(t) for i, t in texts.items()}
    want = groups_of(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in H.op3_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_tiles_lose_no_link(spark):
    """Chains of fingerprints, tiles of every size."""
    rnd, prints = random.Random(5), {}
    for k in range(40):
        x = rnd.getrandbits(64)
        for j in range(12):
            prints[len(prints)] = x
            for b in rnd.sample(range(64), 3):
                x ^= 1 << b
    want = groups_of(prints)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(prints.values())], "bits long")
    for rows, agree in ((4096, 1), (20, 2), (5, 1), (4096, 3), (20, None)):
        roots = {r.node: r.root for r in components(H.links(df, tile_rows=rows, agree=agree)).collect()}
        signed = {i: int(np.uint64(v).view(np.int64)) for i, v in prints.items()}
        root = {i: roots.get(signed[i], signed[i]) for i in prints}
        assert len({(want[i], root[i]) for i in prints}) == len(set(want.values())) == len(set(root.values()))


def test_awkward(spark):
    got = H.near_groups(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    zero = [r for r in got if r.doc_id in (1, 2, 7)]
    assert {(r.fingerprint, r.component_id) for r in zero} == {("0" * 16, 1)}
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert H.near_groups(docs(spark, [])).count() == 0


def test_bands():
    assert H.agreeing(1000) == 1 and H.agreeing(14_000_000) == 2 and H.agreeing(40_000_000_000) == 3
    for agree, choices in ((1, 5), (2, 15), (3, 35)):
        masks = [m % (1 << 64) for m in H.masks_of(4, agree)]
        assert len(masks) == choices
        for flipped in ((0, 1, 2, 3), (3, 20, 41, 63), (12, 25, 38, 51)):
            x = sum(1 << b for b in flipped)
            assert any(x & m == 0 for m in masks)
