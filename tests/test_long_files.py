from gridledger.operators import ingest as I
from tests.test_ingest import HARBOUR, grid


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_below_a_header_are_cut_before_they_are_dealt(spark):
    """Of a file of any length, each task hands on no more rows below a candidate than are looked at."""
    rows = I.normalise(grid(spark, harbour=HARBOUR))
    assert "WindowGroupLimit" in planned(I.looks_like_values(rows, I.header_candidates(rows, I.dominant_width(rows))))
