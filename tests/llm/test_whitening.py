from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridledger.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, k int, n long, w double"


def table(spark, rows):
    """rows: (vec_id, vector); further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5) for i, v in rows], SCHEMA)


def leverrier(m):
    """Coefficients, constant first, of det(x - m), by traces of exact powers."""
    d = len(m)
    m = np.array(m, object)
    c, b = [1], np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        a = m @ b
        t = Fraction(-sum(a[i, i] for i in range(d)), k)
        assert t.denominator == 1
        c.append(int(t))
        b = a + np.array([[int(i == j) * int(t) for j in range(d)] for i in range(d)], object)
    return c[::-1]


def scatter(rng, n, d, size):
    x = rng.integers(-size, size, (n, d)).astype(object)
    s = x.sum(0)
    return (n * (x.T @ x) - np.outer(s, s)).tolist()


@pytest.mark.parametrize("n, d, size", [(50, 1, 9), (3, 6, 5), (40, 7, 1000), (2, 5, 3), (30, 12, 1 << 30)])
def test_characteristic_polynomial(spark, n, d, size):
    m = scatter(np.random.default_rng(d), n, d, size)
    assert W.characteristic(spark, m) == leverrier(m)


def test_polynomial_of_awkward_matrices():
    for m in ([[0, 0, 0], [0, 0, 0], [0, 0, 0]], [[2, 0, 1], [0, 3, 0], [1, 0, 2]], [[1, 0, 0, 4], [0, 1, 0, 0], [0, 0, 5, 0], [4, 0, 0, 1]]):
        for p in (W.TOP, 2147483629, 101):
            assert W.polynomial_modulo(np.array(m, object), p) == [c % p for c in leverrier(m)]
    assert W.is_prime(W.TOP) and [n for n in range(60) if W.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert W.remaindered({7: [3, 5], 11: [8, 9]}) == [(v if 2 * v <= 77 else v - 77) for v in (52, 75)]


def test_roots_are_counted_and_refined():
    poly = [1]
    for root in (0, 3, 3, 3, 7, 10, 10, 12):
        poly = [(poly[i - 1] if i else 0) - root * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [W.above(poly, a) for a in (-1, 0, 2, 3, 7, 9, 10, 11, 12)] == [8, 7, 7, 4, 3, 3, 1, 1, 0]
    assert [(r >> W.PLACES, n) for r, n in W.top_roots(poly, 8, 48)] == [(12, 1), (10, 2), (7, 1), (3, 3)]
    assert [n for _, n in W.top_roots(poly, 2, 48)] == [1, 2]
    root = W.top_roots([-2, 0, 1], 1, 5)[0][0]  # the square root of 2
    assert abs(Decimal(root) / Decimal(1 << W.PLACES) - Decimal(2).sqrt()) < Decimal(10) ** -27
    assert (root - 1) ** 2 < 2 << 2 * W.PLACES <= root**2


def test_null_space():
    m = scatter(np.random.default_rng(3), 40, 9, 500)
    for root, count in W.top_roots(leverrier(m), 4, sum(m[i][i] for i in range(9))):
        (v,) = W.null_space(m, root, count)
        e = Decimal(root) / Decimal(1 << W.PLACES)
        left = [sum((Decimal(a) * x for a, x in zip(row, v)), Decimal(0)) - e * v[i] for i, row in enumerate(m)]
        assert max(map(abs, left)) < Decimal(10) ** -15 * e and abs(sum(x * x for x in v) - 1) < Decimal(10) ** -25
    twice = [[2, 0, 0], [0, 2, 0], [0, 0, 1]]
    a, b = W.null_space(twice, 2 << W.PLACES, 2)
    assert abs(a @ b) < Decimal(10) ** -25 and abs(a[2]) < Decimal(10) ** -25 > abs(b[2])


def exact_rows(vectors):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    return x, n, s, [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]


def against_numpy(got, ids, vectors, k):
    x, n, s, deviation = exact_rows(vectors)
    y = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, k + 1))
    w = np.array([[by[c][i].whitened for c in range(1, k + 1)] for i in ids])
    plain = y @ v / np.sqrt(e)
    flip = np.sign((w * plain).sum(0))
    assert np.allclose(w, plain * flip, atol=1e-7)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    trace = float((y * y).sum() / n)
    for c in range(k):
        assert abs(by[c + 1][ids[0]].explained - e[c] / trace) < 1e-9
    for i, d in zip(ids, deviation):
        assert by[1][i].deviation == d and by[1][i].n == n
    (error,) = {r.identity_error for r in got}
    assert 0 <= error < 1e-9


def test_against_numpy_over_embeddings(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    got = W.op11_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * len(rows)
    against_numpy(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 8)


def test_hot_and_few(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(60, 5))]
    vectors += [vectors[0]] * 40
    against_numpy(W.whitened(table(spark, list(enumerate(vectors)))).collect(), list(range(100)), vectors, 5)


def test_awkward(spark):
    v = [1.0, 2.0, 3.0]
    bad = [(2, None), (3, []), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 1.0, 2.0]), (7, [1.0]), (8, [3e38, 0.0, 0.0])]
    got = W.whitened(table(spark, [(1, v), (1, v), (None, [2.0, 0.0, 3.0]), *bad])).collect()
    assert sorted((r.vec_id is None, r.component, r.n) for r in got) == [(False, 1, 3), (False, 1, 3), (True, 1, 3)]  # the third dimension and one direction don't vary
    assert abs(sum(r.whitened for r in got)) < 1e-12 and {r.explained for r in got} == {1.0}
    for rows in ([], [(1, v)], [(1, v), (2, v)], bad[:1]):
        out = W.whitened(table(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries():
    """Beyond what doubles hold exactly, Python integers take over; a deviation beyond a long is null."""
    x = np.array([[2.0**39, 1.0], [-(2.0**39), 3.0]])
    assert W.products(x).tolist() == [[2 * 4**39, -2 * 2**39], [-2 * 2**39, 10]]
    y, squares = W.deviations(x, 2, np.array([0, 4], object))
    assert squares == [None, None] and y.tolist() == [[2.0**40, -2.0], [-(2.0**40), 2.0]]
    assert W.deviations(np.array([[1.0], [4.0]]), 2, np.array([5], object))[1] == [9, 9]
