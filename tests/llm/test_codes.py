import numpy as np
import pytest

from gridledger.llm import codes as K
from gridledger.llm import vectors
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, row int, x string, entry int, error double"


def table(spark, rows):
    """rows: (vec_id, vector, label); further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, v, lab, 1, "x", 2, 0.5) for i, v, lab in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """Lloyd by the contract, in Python integers: {place: (code, error)} and the codebooks."""
    xs = [[int(np.floor(4096 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, xs[k]))
    width = len(xs[0]) // parts
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[list(part(xs[k], p)) for k in order[:entries]] for p in range(parts)]
    near = lambda p, m: min((sum((a - b) ** 2 for a, b in zip(m, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in xs:
                held.setdefault(near(p, part(x, p))[1], []).append(part(x, p))
            for k, members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[near(p, part(x, p)) for p in range(parts)] for x in xs]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


def test_against_sql(spark, sf_dir):
    compare(K.op13_codes(spark, sf_dir), K.sql(), sf_dir)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_against_plain_lloyd(spark, rounds):
    rnd = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(c)) for c in rnd.normal(size=8)], int(rnd.integers(3)) if i % 7 else None) for i in rnd.permutation(150)]
    rows += [(200 + i, rows[0][1], 1) for i in range(90)]  # one vector has over a third of the rows
    out, books = K.encoded(table(spark, rows), parts=4, entries=6, rounds=rounds)
    want, want_books = plain(rows, 4, 6, rounds)
    assert [b.tolist() for b in books] == want_books
    sums = {}
    for (_, _, label), (_, error) in zip(rows, want):
        sums[label] = sums.get(label, 0) + error
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in out.collect()} == {i: (*w, sums[label]) for (i, _, label), w in zip(rows, want)}


def test_only_movers_are_shuffled(spark):
    """Members that stay keep their partition: without movers a round has the partitioning of the one before."""
    keys = [((p, e, s), (np.arange(3), np.full((3, 2), e))) for p in range(2) for e in range(2) for s in range(3)]
    books = [np.array([[0, 0], [1, 1]])] * 2
    members = spark.sparkContext.parallelize(keys).partitionBy(3, K._owner)
    left, found, held = K.settled_members(members, books, 2, 3)
    assert left.partitioner == members.partitioner and left.getNumPartitions() == 3
    assert "PartitionerAwareUnionRDD" in left.toDebugString().decode()
    assert held.filter(lambda kv: kv[1][2]).count() == 0 and [b.tolist() for b in found] == [b.tolist() for b in books]
    assert sorted(k for k, _ in left.collect()) == sorted(k for k, _ in keys)


def test_owners_share_an_entry():
    for partitions in (1, 7, 211):
        assert len({K._owner((3, 5, s)) % partitions for s in range(partitions)}) == partitions


def test_awkward(spark):
    v = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, v, None), (1, v, None), (2, None, 1), (3, [], 1), (4, [0.5, None, 1.0, 0.0], 1), (5, [0.5, float("nan"), 1.0, 0.0], 1),
            (6, [0.5, float("-inf"), 1.0, 0.0], 1), (None, [0.0, 0.0, 0.0, 0.0], 1), (8, [1.0, 2.0], 1), (9, [3e38, 0.0, 0.0, 0.0], 1)]
    out, books = K.encoded(table(spark, rows), parts=2)
    got = out.collect()
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error, r.label_error) for r in got) == [(False, 1, "0000", 0, 0), (False, 1, "0000", 0, 0), (True, None, "0202", 0, 0)]
    assert len(books[0]) == 3
    out, books = K.encoded(table(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert K.digest_of(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    odd, _ = K.encoded(table(spark, [(i, [float(i), 0.0, 1.0], 1) for i in range(5)]), parts=2, entries=2)
    assert {len(r.code) for r in odd.collect()} == {4}
    few, _ = K.encoded(table(spark, [(1, [1.0, 2.0], 1), (2, [0.0, 2.0], 1)]), parts=4)
    assert [r.code for r in few.orderBy("vec_id").collect()] == ["00000000", "00010000"]  # parts without components are all alike


def test_matrix():
    import pyarrow as pa

    sliced = pa.array([[1, 2], [3, 4], [5, 6]]).slice(1)
    assert vectors.matrix(sliced).tolist() == [[3, 4], [5, 6]]
