"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Entries become integers, so counts, sums and products are summed exactly by many tasks, and the scatter
N = n * (sum of products) - (product of sums) is an exact integer matrix: n^2 times the covariance. (Sums are of
x - OFFSET, small numbers; as all is exact, taking the means off afterwards loses nothing.) Then

1. tasks reduce N modulo primes to Hessenberg form by similarity, and give the characteristic polynomial of each;
   remainders are put together by Chinese remaindering, with as many primes as the coefficients' bound needs;
2. its largest roots, all real, are isolated by Descartes' rule after exact shifts of the polynomial (which counts
   the roots above a point, as no root is complex), and then refined by exact signs to 2^-PLACES;
3. components span the null space of N - root: inverse iteration with `DIGITS` decimal digits, for a multiple root
   with as many vectors as it counts;
4. tasks project every vector, centred by exact integers, on the components.

What reaches the driver is bounded by the dimension d: d^2 sums, and d remainders for each prime.

Defined results: vectors that are null or empty, or hold null or non-finite entries, or entries of 2^30 and more
(whose sums of products may leave 38 digits), are left out, as are those of another length than the commonest;
components without variance have no rows, so one vector or equal ones give none; a deviation beyond a long is null;
null vec_ids and repeated rows each get their rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from math import comb, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common, vectors

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
LIMIT = float(1 << 30)
#: Binary places behind the point of the roots.
PLACES = 160
#: Decimal digits of inverse iteration, and how often it is repeated.
DIGITS, TURNS = 110, 3
#: Largest prime; products of two remainders are longs.
TOP = (1 << 31) - 1
EXACT = 1 << 53


# 1. sums


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as exact doubles: SCALE is a power of two, and a floor of a double is one."""
    return np.floor(x * SCALE)


def products(x: np.ndarray) -> np.ndarray:
    """x'x of whole numbers, as Python integers; by doubles where every sum is exact in them."""
    most = float(np.abs(x).max(initial=0.0))
    if most * most * len(x) < EXACT:
        return (x.T @ x).astype(np.int64).astype(object)
    big = np.array([[int(v) for v in row] for row in x], object)
    return big.T @ big


def _moments(d):
    """A task's count, sums and products (k, value): k is 0, 1 + i, or 1 + d + place of (i, j), i <= j."""
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros(1 + d + len(upper[0]), object)
        for batch in batches:
            x = whole(vectors.matrix(batch.column(0)))
            if len(x):
                sums = np.array([sum(int(v) for v in c) for c in x.T], object)
                total = total + np.concatenate([[len(x)], sums, products(x)[upper]])
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["k", "value"])

    return run


def moments(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(number, sums, sums of products) of floor(SCALE * v) over all rows, exact."""
    part = common.arrow_map(rows.select("v"), _moments(d), "k int, value decimal(38,0)")
    found = {r.k: int(r.value) for r in part.groupBy("k").agg(F.sum("value").alias("value")).collect()}
    at = {p: found.get(1 + d + k, 0) for k, p in enumerate(zip(*map(list, np.triu_indices(d))))}
    return found.get(0, 0), [found.get(1 + i, 0) for i in range(d)], [[at[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


# 2. characteristic polynomial


def is_prime(n: int) -> bool:
    """For n below 2^32 (Miller and Rabin with bases that suffice there)."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if n == base or x in (1, n - 1):
            continue
        if all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes up to TOP whose product has more than `bits` bits."""
    out, have, n = [], 0, TOP
    while have <= bits:
        if is_prime(n):
            out.append(n)
            have += n.bit_length() - 1
        n -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of det(x - matrix) modulo p; matrix: integers."""
    h, d = np.array(matrix % p, np.int64), len(matrix)
    for m in range(1, d - 1):  # clear column m - 1 below row m
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if i := below[0]:
            h[[m, m + i]] = h[[m + i, m]]
            h[:, [m, m + i]] = h[:, [m + i, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # row k: of the leading k x k part
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        factor, weights = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * factor % p
            factor = factor * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d].tolist()


def remaindered(remainders: dict[int, list[int]]) -> list[int]:
    """The integers of smallest size with these remainders by prime."""
    product, value = 1, [0] * len(next(iter(remainders.values())))
    for p, found in remainders.items():
        inverse = pow(product, -1, p)
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, found)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def bound_bits(matrix: list[list[int]]) -> int:
    """Bits that hold twice any coefficient: of d roots that are not negative and have this sum, products of k are at most comb(d, k) * (sum/d)^k."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max((comb(d, k) * (trace**k // d**k + 1)).bit_length() for k in range(d + 1)) + 2


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial of a symmetric matrix without negative roots; primes are dealt to tasks."""
    found = primes(bound_bits(matrix))
    whole_matrix = np.array(matrix, object)

    def run(batches):
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([polynomial_modulo(whole_matrix, p) for p in ps], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(found), 4 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in found], tasks), "p long")
    return remaindered({r.p: r.c for r in common.arrow_map(dealt, run, "p long, c array<long>").collect()})


# 3. roots


def shifted(coefficients: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def above(coefficients: list[int], a: int) -> int:
    """How many roots are over a, each as often as it counts, if all are real: sign changes of the shifted polynomial."""
    signs = [v > 0 for v in shifted(coefficients, a) if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(coefficients: list[int], a: int) -> int:
    out = 0
    for c in reversed(coefficients):
        out = out * a + c
    return out


def top_roots(coefficients: list[int], most: int, high: int, places: int = PLACES) -> list[tuple[int, int]]:
    """[(root, how often it counts)] of the largest positive roots, falling, until they count `most`; roots are
    times 2^places, at most 1 too large. high: not below any root."""
    d = len(coefficients) - 1
    fine = [c << places * (d - i) for i, c in enumerate(coefficients)]  # of roots times 2^places
    isolated, wanted = [], min(most, above(coefficients, 0))
    stack = [(0, high, above(coefficients, 0), 0)]  # (low, high, roots over low, roots over high) with low < root <= high
    while stack:
        low, top, n_low, n_top = stack.pop()
        if n_low == n_top or n_top >= wanted:
            continue
        if n_low - n_top == 1 or top - low == 1:
            isolated.append((low, top, n_low - n_top))
            continue
        mid = (low + top) // 2
        n_mid = above(coefficients, mid)
        stack += [(low, mid, n_low, n_mid), (mid, top, n_mid, n_top)]  # the upper half is next
    out = []
    for low, top, count in isolated:
        out += _refined(fine, low << places, top << places, count)
    return out


def _refined(fine, low, top, count):
    if count == 1:  # one sign on each side; a value of zero is the root
        side = value_at(fine, top) > 0
        if value_at(fine, top) == 0:
            return [(top, 1)]
        while top - low > 1:
            mid = (low + top) // 2
            at = value_at(fine, mid)
            if at == 0:
                return [(mid, 1)]
            low, top = (low, mid) if (at > 0) == side else (mid, top)
        return [(top, 1)]
    if top - low == 1:
        return [(top, count)]
    mid = (low + top) // 2
    over = above(fine, mid) - above(fine, top)
    return [x for lo, hi, n in ((mid, top, over), (low, mid, count - over)) if n for x in _refined(fine, lo, hi, n)]


# 4. components


def _factors(a: list[np.ndarray], tiny: Decimal):
    """Rows of a, factored in place with partial pivoting; gives the order of rows. A zero pivot becomes tiny."""
    order = list(range(len(a)))
    for k in range(len(a)):
        best = max(range(k, len(a)), key=lambda i: abs(a[i][k]))
        a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        for i in range(k + 1, len(a)):
            if a[i][k]:
                a[i][k] = f = a[i][k] / a[k][k]
                a[i][k + 1 :] = a[i][k + 1 :] - f * a[k][k + 1 :]
    return order


def _solved(a, order, b):
    x = [b[i] for i in order]
    for k in range(len(a)):
        x[k] -= sum((a[k][j] * x[j] for j in range(k)), Decimal(0))
    for k in range(len(a) - 1, -1, -1):
        x[k] = (x[k] - sum((a[k][j] * x[j] for j in range(k + 1, len(a))), Decimal(0))) / a[k][k]
    return np.array(x, object)


def null_space(matrix: list[list[int]], root: int, count: int, places: int = PLACES) -> list[np.ndarray]:
    """`count` orthonormal vectors, as Decimals, that matrix - root / 2^places takes to almost nothing."""
    with localcontext(Context(prec=DIGITS)):
        shift, d = Decimal(root) / Decimal(1 << places), len(matrix)
        a = [np.array([Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)], object) for i, row in enumerate(matrix)]
        order = _factors(a, Decimal(10) ** (-DIGITS) * (1 + sum(matrix[i][i] for i in range(d))))
        rnd = np.random.default_rng(11)
        basis = [np.array([Decimal(int(v)) for v in rnd.integers(1, 1 << 20, d)], object) for _ in range(count)]
        for _ in range(TURNS):
            turned = []
            for v in basis:
                v = _solved(a, order, v)
                for _ in range(2):  # twice, so that what rounding left of the others goes too
                    v = v / (v @ v).sqrt()
                    for u in turned:
                        v = v - (v @ u) * u
                turned.append(v / (v @ v).sqrt())
            basis = turned
        return basis


def components(spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(vectors by row, roots) of the largest roots of an integer scatter, in doubles; the entry of largest size is positive."""
    common_factor = gcd(*[v for row in matrix for v in row]) or 1
    small = [[v // common_factor for v in row] for row in matrix]
    trace = sum(small[i][i] for i in range(len(small)))
    rows, roots = [], []
    for root, count in top_roots(characteristic(spark, small), most, trace) if trace else []:
        for v in null_space(small, root, count):
            v = np.array([float(c) for c in v])
            rows.append(v * np.sign(v[np.abs(v).argmax()]))
            roots.append(float(Decimal(root) / Decimal(1 << PLACES) * common_factor))
    d = len(small)
    return np.array(rows[:most]).reshape(-1, d), np.array(roots[:most])


# 5. whitened rows


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list]:
    """(n*x - sums as doubles, sums of its squares, exact, None beyond a long)."""
    y = n * x - sums.astype(float)
    most = float(np.abs(y).max(initial=0.0))
    if max(most, n * float(np.abs(x).max(initial=0.0)), float(np.abs(sums.astype(float)).max(initial=0.0))) < EXACT and most * most * y.shape[1] < 1 << 62:
        return y, (y.astype(np.int64) ** 2).sum(1).tolist()
    exact = [[n * int(v) - int(s) for v, s in zip(row, sums)] for row in x]
    squares = [sum(v * v for v in row) for row in exact]
    return np.array(exact, float).reshape(y.shape), [s if s < 1 << 63 else None for s in squares]


def _whitened(n, sums, vecs, roots):
    def run(batches):
        scale = vecs.T / np.sqrt(roots)
        for batch in batches:
            x = whole(vectors.matrix(batch.column(1)))
            y, squares = deviations(x, n, sums)
            w = y @ scale if len(y) else np.zeros((0, len(roots)))
            yield pa.record_batch([batch.column(0), pa.array(squares, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    return run


def _second_moments(k):
    """A task's sums and sums of products of whitened values."""

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = vectors.matrix(batch.column(0))
            if len(w):
                total += np.vstack([w.sum(0), w.T @ w])
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "value"])

    return run


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest entry, by size, of the covariance of w minus the identity."""
    part = common.arrow_map(rows.select("w"), _second_moments(k), "k int, value double").withColumn("value", F.col("value").cast("decimal(38,15)"))
    found = {r.k: float(r.value) for r in part.groupBy("k").agg(F.sum("value").alias("value")).collect()}
    total = np.array([found[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whitened(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that counts and each component."""
    spark = table.sparkSession
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(vectors.sound(LIMIT, "v"))
    rows, d = vectors.of_one_length(rows, "v")
    n, sums, squares = moments(rows, d) if d else (0, [], [])
    scatter = [[n * squares[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    vecs, roots = components(spark, scatter, most) if d else (np.zeros((0, 0)), np.zeros(0))
    if not len(roots):
        rows = rows.limit(0)
    each = common.arrow_map(rows, _whitened(n, np.array(sums, object), vecs, roots), "vec_id long, deviation long, w array<double>")
    error = identity_error(each, n, len(roots)) if len(roots) else 0.0
    trace = sum(scatter[i][i] for i in range(d))
    share = F.array(*[F.lit(float(Decimal(r) / Decimal(trace))) for r in roots.tolist()]).cast("array<double>")
    out = each.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
