import random

from pyspark.sql import functions as F

from gridledger.operators import coverage as C
from gridledger.operators import cuts as W
from gridledger.operators import dashboards as D
from tests.conftest import rows_of


def rows(spark, n=300):
    rnd = random.Random(2)
    at = rnd.sample(range(-1000, 3000), n)
    return spark.createDataFrame([(rnd.choice(["a", "a", "a", None, "b"]), i, rnd.choice(["x", "x", "y", None])) for i in at], "p string, n long, key string").repartition(5)


def test_previous_and_numbered(spark):
    """Whatever the ranges, as the plain windows have it: null values, null partitions, empty ranges between."""
    d = rows(spark)
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("n")
    want = rows_of(d.select("p", "n", F.lag("key").over(w).alias("before"), F.row_number().over(w).alias("place")), "p", "n", "before", "place")
    for span in (1, 7, 250, 1 << 20):
        got = W.numbered(W.previous(d, ["p"], "n", "key", "before", span), ["p"], F.col("n"), [F.col("n")], "place", span)
        assert rows_of(got, "p", "n", "before", "place") == want
    falling = W.numbered(d, ["p"], -F.col("n"), [F.col("n").desc()], "place", 40)
    back = d.withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy(F.col("n").desc())))
    assert rows_of(falling, "p", "n", "place") == rows_of(back, "p", "n", "place")
    assert W.previous(d.limit(0), ["p"], "n", "key", "before").count() == 0


def test_blocks_of_a_hot_section(spark):
    d = rows(spark)
    for span in (3, 100):
        assert rows_of(C.occurrence_blocks(d, ["p"], "n", span), "p", "n", "starts") == rows_of(C.occurrence_blocks(d, ["p"], "n"), "p", "n", "starts")
    plan = C.occurrence_blocks(d, ["p"], "n", 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p" in plan and ", _cut" in plan  # windows over rows run within ranges


def test_search_by_postings(spark):
    """The rows of the scan, from few candidates."""
    rnd = random.Random(7)
    words = ["Alpha", "beta gamma", "GAMMAlpha", "delta", "phase", "lph", "al", "", None, "ünïlpha"]
    table = spark.createDataFrame([(i, rnd.choice(words), rnd.choice(words), float(i % 9)) for i in range(200)], "k int, section string, t string, x double")
    postings = D.search_postings(table, ["section", "t"], "k")
    how = {"section": "section", "texts": ["t"], "numbers": ["x"], "order": ["k"], "size": 500}
    for query in ("alph", "LPH", "gamma", "nothing here", "al", "7", "mal", "ïlp", ""):
        want = rows_of(D.search_records(table, query, **how), "k", "n_total")
        assert rows_of(D.search_indexed(table, postings, query, "k", **how), "k", "n_total") == want
    found = D.search_candidates(postings, "gammalpha", "k")
    exact = table.filter("contains(lower(section), 'gammalpha') OR contains(lower(t), 'gammalpha')")
    assert exact.count() <= found.count() < 120 and exact.join(found, "k", "left_anti").count() == 0
    assert D.search_candidates(postings, "al", "k") is None
    within = D.search_indexed(table, postings, "lph", "k", within="Alpha", **how)
    assert rows_of(within, "k") == rows_of(D.search_records(table, "lph", within="Alpha", **how), "k")
