import hashlib
from collections import Counter, defaultdict

from gridledger.llm import exact_dedup as X
from gridledger.llm import queries as Q
from tests.llm.helpers import AWKWARD, docs
from tests.oracle import compare


def test_sql(spark, sf_dir):
    compare(X.op10_exact_dedup(spark, sf_dir), Q.oracle_sql()["op10_exact_dedup"], sf_dir)


def test_awkward(spark):
    got = X.exact_dedup(docs(spark, AWKWARD)).collect()
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[t or ""].append(i)
    assert len(got) == len(AWKWARD)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        keep = max([i for i in ids if i is not None], default=None)
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert sum(r.kept for r in own) == 1 and all(r.doc_id == keep for r in own if r.kept)


def found(spark, rows, **how):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.exact_dedup(docs(spark, rows), **how).collect())


def test_small_buckets(spark):
    """Splits, doubling and overflow pages change nothing."""
    rows = [(i, f"text {i % 40}") for i in range(400)] + [(1000 + i, "hot") for i in range(300)]
    want = found(spark, rows)
    assert len(want) == 700 and found(spark, rows, capacity=2000) == want and found(spark, rows, capacity=200) == want


def plain(rows):
    """What (doc_id, body) rows give, whatever their hashes."""
    size, keep = Counter(b for _, b in rows), {}
    for i, b in rows:
        keep[b] = max(keep.get(b, i), i)
    return sorted((i, keep[b], size[b], i == keep[b], hashlib.sha256(b).hexdigest()) for i, b in rows)


def test_texts_with_one_hash_are_told_apart(spark):
    """Hashes are forged: all alike, or alike in their first bits. Bytes decide, in chains and over pages."""
    rows = [(i, f"text {i % 5}".encode()) for i in range(600)] + [(1000 + i, b"x" * (i % 3)) for i in range(60)]
    for key, capacity in ((7, 1 << 20), (7, 900), (-1, 900), (0, 40_000)):
        base = spark.createDataFrame([(i, b, key) for i, b in rows], "doc_id long, body binary, key long")
        got = X.classes(base, capacity)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.first, r.text_sha256) for r in got.collect()) == plain(rows)
    forged = [(i, b, (5 << 58) + (sum(b) % 4)) for i, b in rows]  # they differ in the last two bits only
    got = X.classes(spark.createDataFrame(forged, "doc_id long, body binary, key long"), 20_000)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.first, r.text_sha256) for r in got.collect()) == plain(rows)


def test_nulls_and_repeats_over_pages(spark):
    rows = [(None, "same")] * 40 + [(None, "other"), (None, "other")] + [(3, "third"), (3, "third"), (None, "third")] * 20
    for capacity in (1 << 20, 300):
        got = X.exact_dedup(docs(spark, rows), capacity=capacity).collect()
        assert len(got) == len(rows)
        for text, keep, size in (("same", None, 40), ("other", None, 2), ("third", 3, 60)):
            own = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
            assert {(r.keep_id, r.group_size) for r in own} == {(keep, size)} and sum(r.kept for r in own) == 1
            assert all(r.doc_id == keep for r in own if r.kept)


def test_directory(spark):
    """Buckets are the largest ranges within the capacity; the directory doubles past any number of bits."""
    loads = lambda rows: spark.createDataFrame(rows, "key long, load long")
    rows = [(k << 60, 10) for k in range(-8, 8)]
    entries, depth = X.directory(loads(rows), capacity=25)
    bucket = {r.cell: r.bucket for r in entries.collect()}
    of = lambda key: bucket[(key % (1 << 64)) >> (64 - depth)]
    assert len({of(k) for k, _ in rows}) == 8 and all(of(k << 60) == of((k + 1) << 60) for k in range(-8, 8, 2))
    entries, depth = X.directory(loads([(6, 20), (7, 20), (-1, 5)]), capacity=25)
    assert depth == 64 and len({r.bucket for r in entries.collect()}) == 3
    entries, depth = X.directory(loads([(6, 20)]), capacity=25)
    assert depth <= X.FINER_BITS and entries.count() == 1
    assert X.directory(loads([]), capacity=25)[0].count() == 0


def test_empty_and_columns(spark):
    none = docs(spark, [])
    assert X.exact_dedup(none).count() == 0
    d = docs(spark, AWKWARD)
    kept = X.drop_copies(d)
    assert kept.columns == d.columns and kept.count() == len({t or "" for _, t in AWKWARD})
