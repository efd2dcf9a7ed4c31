from gridledger.operators import ingest as I


def test_files_are_not_broadcast(spark):
    """widths has a row for each file, so nothing may force it to the driver."""
    grid = spark.createDataFrame([("f", 0, ["a", "b"]), ("f", 1, ["1", "2"])], "file string, row_no int, cells array<string>")
    rows = I.normalise(grid)
    found = I.header_candidates(rows, I.dominant_width(rows))
    assert "broadcast" not in found._jdf.queryExecution().logical().toString().lower()
    assert {tuple(r) for r in found.collect()} == {("f", 0, 0), ("f", 1, 0), ("f", 2, 0)}
