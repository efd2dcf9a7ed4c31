from collections import defaultdict

from gridledger.llm import mixing as M
from gridledger.llm import queries as Q
from tests.llm.helpers import AWKWARD, docs
from tests.oracle import compare


def test_sql(spark, sf_dir):
    compare(M.op2_mixing(spark, sf_dir), Q.oracle_sql()["op2_mixing"], sf_dir)


def filled(sizes, weights, cap=3):
    """Targets by sharing again and again."""
    names, total = sorted(sizes, key=lambda s: (s is None, s or "")), sum(sizes.values())
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), total
    while open_:
        share = {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_words(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", None if i % 5 == 0 else "a" if i < 400 else f"s{i % 4}") for i in range(600)] + [(900, "x y z", "en", "tiny"), (901, "", "en", "none")]
    got = M.mix(docs(spark, rows), block_words=8).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    want = filled(sizes, (1, 2, 3))
    for s in sizes:
        assert abs(want[s] - next(r.target for r in got if r.source == s)) < 1e-6
        assert abs(taken[s] - want[s]) <= 1
    again = M.mix(docs(spark, rows[::-1]).repartition(3), block_words=8).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_schedule_is_even(spark):
    """Any stretch of slots holds each source about as often as its weight says."""
    need = spark.createDataFrame([(0, 60), (1, 120), (2, 180)], "source_no int, slots long").selectExpr("*", "360L AS all_slots")
    need = need.selectExpr("source_no", "slots", "all_slots", "cast(floor((CASE source_no WHEN 0 THEN 0 WHEN 1 THEN 60 ELSE 180 END) / 360 * 1099511627776) AS long) AS from_point", "cast(floor((CASE source_no WHEN 0 THEN 60 WHEN 1 THEN 180 ELSE 360 END) / 360 * 1099511627776) AS long) AS to_point")
    got = sorted((r.slot, r.source_no, r.rank) for r in M.schedule(need).collect())
    assert [sum(x[1] == s for x in got) for s in range(3)] == [60, 120, 180]
    first = [s for slot, s, _ in got if slot < 60]
    assert abs(first.count(2) - 30) <= 4 and abs(first.count(0) - 10) <= 4
    for s in range(3):
        assert [r for _, x, r in got if x == s] == list(range([60, 120, 180][s]))


def test_awkward(spark):
    got = M.mix(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.taken == 0 for r in got if r.size == 0)
    assert M.mix(docs(spark, [])).count() == 0
    d = docs(spark, AWKWARD)
    assert M.repeat_documents(d).columns == d.columns
