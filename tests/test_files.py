import random

import duckdb
from pyspark.sql import functions as F

from gridledger.operators import coverage as C
from gridledger.sources import files as X


def cells(spark, path):
    return [r.cells for r in X.csv_grid(spark, str(path)).orderBy("row_no").collect()]


def test_stray_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a 5" b,c\nd,e\n"x, ""y""","two\r\nlines",z\n\n,,\nlast,"",\n', newline="")
    assert cells(spark, tmp_path / "a.csv") == [['a 5" b', "c"], ["d", "e"], ['x, "y"', "two\r\nlines", "z"], ["last"]]
    (tmp_path / "b.csv").write_text("﻿one\r\n1,2,3\r\n", newline="")
    assert cells(spark, tmp_path / "b.csv") == [["one"], ["1", "2", "3"]]
    (tmp_path / "c.csv").write_text("")
    assert cells(spark, tmp_path / "c.csv") == []
    both = X.read_grid(spark, str(tmp_path), "csv")
    assert sorted((r.file.rsplit("/", 1)[1], r.row_no) for r in both.collect()) == [("a.csv", 0), ("a.csv", 1), ("a.csv", 2), ("a.csv", 4), ("b.csv", 0), ("b.csv", 1)]


def test_csv_equals_another_reader(spark, tmp_path):
    rnd, lines = random.Random(3), []
    for i in range(400):
        cell = lambda: rnd.choice(["plain", "", 'half 5" wide', '"quoted, ""deep"""', '"two\nlines"', "ünï 日本", "  spaces  ", "12.5"])
        lines.append(f"r{i}," + ",".join(cell() for _ in range(4)))
    path = tmp_path / "d.csv"
    path.write_text("\n".join(lines) + "\n", newline="")
    want = duckdb.sql(f"SELECT * FROM read_csv('{path}', header = false, all_varchar = true, delim = ',', quote = '\"', escape = '\"', strict_mode = false, auto_detect = false, columns = {{'a': 'VARCHAR', 'b': 'VARCHAR', 'c': 'VARCHAR', 'd': 'VARCHAR', 'e': 'VARCHAR'}})").fetchall()
    full = [[*r, *[None] * (5 - len(r))] for r in cells(spark, path)]
    blank = lambda rows: [[c or None for c in r] for r in rows]
    assert blank(full) == blank(want)


def test_files_that_are_rejected_are_never_opened(spark, tmp_path):
    for name, size in (("r1/a.xlsx", 10), ("r1/b.XLSM", 90), ("r1/deep/c.xlsx", 5), ("r1/deep/er/d.xlsx", 5), ("r1/e.txt", 10), ("r1/~$f.xlsx", 10), ("r1/.g.xlsx", 10)):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    root = F.lit(str(tmp_path / "r1"))
    got = X.scan_files(spark, str(tmp_path / "r1"), root, F.lit("r1"), max_bytes=50)
    rows = {r.path: (r.size, r.error, r.file_hash) for r in got.collect()}
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "r1"))
    want = {r.path: (r.size, r.error, r.file_hash if r.error is None else None) for r in X.file_manifest(whole, root, F.lit("r1"), max_bytes=50).collect()}
    assert rows == want and set(rows) == {"a.xlsx", "b.XLSM", "deep/c.xlsx"} and rows["b.XLSM"][1:] == ("file_too_large", None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan.replace(" ", "") and plan.count("content") > 0
    listing = X.file_manifest(whole.select("path", "modificationTime", "length"), root, F.lit("r1"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing


def test_an_ordered_export(spark, tmp_path):
    rnd = random.Random(6)
    keys = rnd.sample(range(1, 5000), 600)
    entries = spark.createDataFrame([(f"FL-{k}", rnd.choice(["covered", "missing_in_system", "missing_in_feature", "unresolved"]), k) for k in keys], "key string, status string, k int").repartition(7)
    ordered = C.order_entries(entries)
    rank = {"missing_in_system": 0, "missing_in_feature": 1, "covered": 2, "unresolved": 3}
    want = [(r.key, r.status) for r in sorted(entries.collect(), key=lambda r: (rank[r.status], r.k))]
    X.write_csv(ordered.select("key", "status", "status_rank", "natural_key"), str(tmp_path / "c"), ["status_rank", "natural_key"], ("status_rank", "natural_key"))
    parts = sorted((tmp_path / "c").glob("part-*.csv"))
    lines = [tuple(line.split(",")) for p in parts for line in p.read_text().splitlines()[1:]]
    assert lines == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = X.numbered(ordered, ["status_rank", "natural_key"])
        assert [(r.key, r.status) for r in got.orderBy("row_no").collect()] == want and sorted(r.row_no for r in got.collect()) == list(range(1, 601))
        plan = ordered.orderBy("status_rank", "natural_key")._jdf.queryExecution().toString()
        assert "rangepartitioning" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
