import random

from gridledger.operators import ingest as I
from gridledger.operators import scan as S
from tests.test_ingest import HARBOUR, STOCK, grid, values
from tests.test_long_files import planned


def test_short_files_are_dealt_once(spark):
    """Files of few rows go through both machines in one pass, also where their row numbers lie far apart."""
    rows = I.normalise(grid(spark, harbour=HARBOUR, stock=STOCK).withColumn("row_no", I.F.col("row_no") * 10_000))
    data = I.assign_rows(rows, I.find_headers(rows))
    assert planned(data).count("MapInArrow") == 1
    assert [(r, s, v) for f, r, s, v in values(data) if f == "harbour"][:2] == [(20_000, "Pier north", ["K1", "grease cable", "4"]), (30_000, "Pier north", ["K1", "swap hook", "6"])]


def test_one_pass_is_as_blocks(spark):
    """Random sheets with rows above the header: whole, and cut into blocks of three rows."""
    rnd, files = random.Random(3), {}
    for k in range(12):
        above = [[f"plan {k}.{i}", None, None, None] for i in range(rnd.randrange(6))]
        below = [[f"{c}{n}" if rnd.random() < 0.5 else None for c in "abcd"] if rnd.random() < 0.7 else [None] * (at := rnd.randrange(4)) + [rnd.choice(["Part", "more", "7"])] + [None] * (3 - at) for n in range(30)]
        files[f"f{k}"] = [*above, ["Alpha", "Beta", "Gamma"], *below]
    rows = I.normalise(grid(spark, **files))
    heads = spark.createDataFrame([(f, next(i for i, r in enumerate(x) if r[0] == "Alpha"), 0, ["Alpha", "Beta", "Gamma"]) for f, x in files.items()], "file string, header_row int, start int, labels array<string>")
    body = I.kept(I.body_rows(rows, heads))
    told = lambda block: sorted((r.file, r.row_no, r.section, [v and (v.s, v.n) for v in r.vals]) for r in I.rows_of_body(body, I.count_rows(body), block).collect())
    whole = told(S.BLOCK)
    assert len(whole) > 100 and whole == told(3) == told(32)
