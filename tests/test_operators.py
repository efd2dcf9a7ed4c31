from pyspark.sql import functions as F

from gridledger.operators import automation as A
from gridledger.operators import coverage as C
from gridledger.operators import dashboards as D
from gridledger.operators import facts as G
from gridledger.operators import quality as Q
from gridledger.operators import snapshots as S
from gridledger.sources import files as X
from tests.conftest import rows_of

COLUMNS = "snapshot_id string, pos int, key string, label string, type string"


def sides(spark):
    f = spark.createDataFrame([("a", "s", 1, "FL-1001"), ("a", "s", 2, "FL-1001"), ("a", "s", 3, "FL-1002"), ("a", "s", 4, "FL-1003"), ("a", "s", 5, "prose only")], "file string, section string, n int, cell string")
    s = spark.createDataFrame([("b", "s", 1, "fl 1001"), ("b", "s", 2, "FL_1002"), ("b", "s", 3, "FL-2001"), ("b", "s", 4, "FL-1002")], "file string, section string, n int, cell string")
    return C.with_identifier(f, "cell"), C.with_identifier(s, "cell")


def test_coverage(spark):
    f, s = (C.side_keys(x, ["file", "section"], "n") for x in sides(spark))
    entries = C.compare_sides(f, s)
    # repeats that follow each other are one block; a later repeat is a duplicate
    assert rows_of(entries, "key", "status", "duplicate") == [("fl1001", "covered", False), ("fl1002", "covered", True), ("fl1003", "missing_in_system", False), ("fl2001", "missing_in_feature", False)]
    one = C.coverage_summary(entries).first()
    assert (one.feature_total, one.system_total, one.covered, one.duplicates, one.forward_pct, one.backward_pct) == (3, 3, 2, 1, 66.7, 66.7)
    assert C.coverage_summary(entries.limit(0)).first().forward_pct == 100.0
    assert C.unresolved_entries(sides(spark)[0], "feature", "cell", "n").count() == 1


def test_id_references(spark):
    rows = spark.createDataFrame([("f", i, f"FL-{5700 + i}", "see FL-5702" if i == 1 else "names FL-9999" if i == 4 else "none") for i in range(8)], "file string, n int, cell string, notes string")
    got = C.id_references(C.with_identifier(rows, "cell"), ["cell", "notes"], "cell", "file", "n")
    assert rows_of(got, "display", "token", "inside") == [("FL-5701", "FL-5702", True), ("FL-5704", "FL-9999", False)]


def test_run_results(spark):
    rows = spark.createDataFrame([(30, 27, 2, 1, "night"), (22, 21, 1, 0, "day"), (16, 12, 1, 3, "night"), (9, 8, 0, 1, "dusk"), (11, 10, 1, 0, "dawn")], "tc int, ok int, bad int, na int, kind string")
    r = D.run_summary(rows, "ok", "bad", "na", "tc").first()
    assert (r.passed, r.failed, r.not_run, r.total, r.executed, r.pass_rate_pct, r.executed_pct, r.reconciles) == (78, 5, 5, 88, 83, 94.0, 94.3, True)
    d = D.dimension_breakdown(rows, "kind", ["ok", "bad"])
    assert [tuple(x) for x in d.filter("value = 'night'").select("ok", "bad", "rank").collect()] == [(39.0, 3.0, 1)]
    worst = D.failing_rows(rows, "bad", F.col("kind"), ["tc"], ["bad"])
    assert [x.bad for x in worst.collect()] == [2, 1, 1, 1]
    cols = spark.createDataFrame([("s", 0, "no", "Line No.", "number"), ("s", 1, "tc", "TC count", "number"), ("s", 2, "ok", "Pass", "number"), ("s", 3, "bad", "Fail", "number"), ("s", 4, "na", "NA", "number"), ("s", 5, "age", "%age", "number")], COLUMNS)
    assert [tuple(x) for x in D.detect_run_columns(cols).collect()] == [("s", "ok", "bad", "na", "tc", True)]
    assert D.primary_measure(cols).first().measure == "na"


def test_weighted_status(spark):
    rows = spark.createDataFrame([("Passed", 12), ("Passed", 18), ("Failed", 9), ("Passed", 14), (None, 99)], "s string, n int")
    r = D.status_summary(D.status_breakdown(rows, "s", "n")).first()
    assert (r.passed, r.failed, r.decided, r.pass_rate_pct, r.statuses) == (44, 9, 53, 83.0, "Passed,Failed")


def test_merged(spark):
    cells = spark.createDataFrame([("a", "Camera", 0, "n", "10", 10.0), ("a", "Camera", 1, "n", "20", 20.0), ("a", "General", 2, "n", "7", 7.0), ("b", "General", 0, "tc", "57", 57.0), ("b", "General", 1, "tc", "43", 43.0), ("b", "General", 2, "tc", "12", 12.0)], "snapshot_id string, section string, row_index int, key string, s string, n double")
    cols = spark.createDataFrame([("a", 0, "n", "Test Count", "number"), ("b", 0, "tc", "TC count", "number")], COLUMNS)
    cur = spark.createDataFrame([("a", "l"), ("b", "l")], "snapshot_id string, layer string")
    assert rows_of(D.merged_dashboard(cells, cols, cur), "section", "measure", "total", "is_shared") == [("Camera", "total_tests", 30.0, True), ("General", "total_tests", 119.0, True)]
    assert S.layer_test_counts(cells, cols, cur, "layer").first().test_count == 149.0
    two = cols.union(spark.createDataFrame([("b", 1, "t2", "Tests", "number")], COLUMNS))
    assert S.layer_test_counts(cells, two, cur, "layer").first().test_count is None


def test_diff_and_fingerprint(spark):
    schema = "f string, k int, v string"
    a = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("x", 3, None)], schema)
    b = spark.createDataFrame([("x", 1, "a"), ("x", 2, "c"), ("x", 4, "d")], schema)
    assert [tuple(r) for r in S.diff_counts(a, b, ["f"], "k", ["v"]).collect()] == [("x", 1, 1, 1)]
    of = lambda df: S.fingerprint(df, ["f"], "k", ["v"]).first().fingerprint
    assert of(a) == of(a.repartition(3)) != of(b)
    # a value that moves to the next column, rows that are there twice, and columns show
    two = "f string, k int, v string, w string"
    moved = [S.fingerprint(spark.createDataFrame([("x", 1, *vw)], two), ["f"], "k", ["v", "w"]).first().fingerprint for vw in ((None, "u"), ("u", None), (None, None))]
    twice = [S.fingerprint(spark.createDataFrame([("x", 1, "p", "q")] * n, two), ["f"], "k", ["v", "w"]).first().fingerprint for n in (1, 2, 3)]
    named = [S.fingerprint(a, ["f"], "k", ["v"], spark.createDataFrame([("x", 0, "v", label, "string")], "f string, pos int, key string, label string, type string")).first().fingerprint for label in ("V", "W")]
    assert len({*moved, *twice, *named}) == 8


def test_dedupe(spark):
    df = spark.createDataFrame([("f", 1, "k", 5), ("f", 2, "k", 5), ("f", 3, "k", 6), ("f", 4, "j", 1)], "f string, n int, key string, m int")
    kept, dropped = S.dedupe_first(df, ["f"], "key", "n", ["m"])
    assert rows_of(kept, "n") == [(1,), (4,)]
    assert rows_of(dropped, "n", "conflicts", "kept_row") == [(2, [], 1), (3, ["m"], 1)]
    assert rows_of(Q.duplicate_warnings(dropped, "f"), "code") == [("conflicting_duplicate",), ("duplicate_rows",)]


def test_renames(spark):
    cur = spark.createDataFrame([("l", "old", "h1"), ("l", "same", "h2"), ("l", "e1", ""), ("l", "d1", "h3"), ("l", "d2", "h3")], "layer string, file string, content_hash string")
    new = spark.createDataFrame([("l", "new", "h1"), ("l", "same", "h2"), ("l", "empty", ""), ("l", "either", "h3")], "layer string, file string, content_hash string")
    assert rows_of(S.detect_renames(new, cur, new), "file", "old_file") == [("new", "old")]


def test_backfill(spark):
    rec = spark.createDataFrame([(None, "r1"), (None, "r1"), (None, "r1"), (None, None), ("s", "r1")], "snapshot_id string, release string").withColumn("app", F.lit("a"))
    up = spark.createDataFrame([("a", "r1", "f1", 1, 5), ("a", "r1", "f2", 2, 3)], "app string, release string, file_name string, uploaded_at int, total_rows int")
    got, skipped = S.backfill_orphans(rec, up, ["app", "release"])
    assert rows_of(got, "row_count", "file", "total_rows", "sequence") == [(3, "f2", 8, 1)] and skipped.first().skipped == 1


def test_automation(spark):
    cells = spark.createDataFrame([("a", "x", 20.0), ("a", "y", 100.0), ("b", "x", 3.0), ("c", "x", None), ("c", "y", 50.0), ("d", "y", 7.0), ("e", "x", 1.0), ("e", "y", 0.0)], "snapshot_id string, key string, n double")
    roles = spark.createDataFrame([("a", "x", "y"), ("b", "x", None), ("c", "x", "y"), ("d", None, "y"), ("e", "x", "y")], "snapshot_id string, automated string, total string")
    rows = spark.createDataFrame([(s, "r", s, 30) for s in "abcde"], "snapshot_id string, release string, layer string, n_rows long")
    layers = A.measure_layers(cells, roles, rows, ["release", "layer"])
    assert rows_of(layers, "layer", "measured", "automated", "total", "coverage_pct", "basis") == [
        ("a", True, 20.0, 100.0, 20.0, "test_count"), ("b", True, 3.0, 30.0, 10.0, "row_count"), ("c", True, 0.0, 50.0, 0.0, "test_count"),  # a blank column is 0
        ("d", False, 0.0, 0.0, None, ""), ("e", False, 1.0, 0.0, None, "test_count")]
    assert {r.layer for r in layers.filter("reason <> ''").collect()} == {"d", "e"}
    rel = A.release_coverage(layers, ["release"], "layer").first()
    assert (rel.coverage_pct, rel.unmeasured, rel.basis) == (12.8, "d,e", "mixed")
    t = spark.createDataFrame([("a", 1, "one", 10.0), ("a", 2, "two", None), ("a", 3, "three", 25.0)], "app string, ord int, name string, coverage_pct double")
    assert [(r.delta, r.compared_to) for r in A.automation_trend(t, ["app"], "ord", "name").orderBy("ord").collect()] == [(None, None), (None, None), (15.0, "one")]


def test_pyramid(spark):
    df = spark.createDataFrame([("r", 0, "unit", 10, 100), ("r", 1, "feature", 20, 50), ("r", 2, "system", 30, 60), ("r", 3, "accept", 5, None), ("r", 4, "none", 0, None)], "rel string, ord int, name string, n int, tests int")
    got = G.pyramid(df, ["rel"], "ord", "name", "n", "tests")
    assert [r.verdict for r in got.collect()] == ["holds", "violated", "holds", "not checked"]


def test_text_checks(spark):
    claims = spark.createDataFrame([("r", "We ran 1,200 cases; regression has conflicting rows"), ("r", "FL-576 is open at 53.8%")], "report string, text string")
    facts = spark.createDataFrame([("r", '{"cases": 1200, "id": "FL-576"}')], "report string, facts string")
    assert rows_of(G.unverified(claims, facts, "report", "text", "facts"), "figure") == [("53.8",)]
    need = spark.createDataFrame([("r", "total", "1200"), ("r", "rate", "94.6")], "report string, label string, value string")
    missing = G.missing_figures(claims, need, "report", "text")
    assert rows_of(missing, "label") == [("rate",)]
    ids = spark.createDataFrame([("r", "FL-5761"), ("r", "fl 576")], "report string, id string")
    assert rows_of(G.missing_ids(claims, ids, "report", "text"), "id") == [("FL-5761",)]  # compared whole
    warn = spark.createDataFrame([("r", "Regression tests", "conflicting_duplicate", "problem"), ("r", "Unit", "mismatched_id", "problem"), ("r", "Unit", "text_in_measure", "notice")], "report string, layer string, code string, severity string")
    assert rows_of(G.missing_warnings(claims, warn, "report", "text"), "layer") == [("Unit",)]
    assert G.fill_gaps(claims, missing, "report", "text").filter("added").count() == 1


def test_merged_top_rows(spark):
    cells = spark.createDataFrame([("a", "s", i, 0, "t", f"row {i}", None) for i in range(3)] + [("a", "s", i, 1, "n", str(i), float(i)) for i in range(3)] + [("b", "u", 0, 0, "q", "5", 5.0), ("b", "u", 1, 0, "q", "x", None)], "snapshot_id string, section string, row_index int, pos int, key string, s string, n double")
    cols = spark.createDataFrame([("a", 0, "t", "Text", "string"), ("a", 1, "n", "Test Count", "number"), ("b", 0, "q", "TC count", "number")], COLUMNS)
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_id string, created_at int")
    got = D.merged_top_rows(cells, cols, cur, 3).orderBy("rank").collect()
    assert [(r.snapshot_id, r.value, r.label, r.measure) for r in got] == [("b", 5.0, "u", "total_tests"), ("a", 2.0, "row 2", "total_tests"), ("a", 1.0, "row 1", "total_tests")]
    other = cols.withColumn("label", F.when(F.col("snapshot_id") == "b", "Hours").otherwise(F.col("label")))
    assert D.merged_top_rows(cells, other, cur).count() == 0  # nothing is shared


def test_warning_order(spark):
    every = spark.createDataFrame([("f", c, "notice", "m") for c in Q.CODES[::-1]] + [("f", "own_code", "notice", "m")], "file string, code string, severity string, message string")
    got = [r.code for r in Q.inspect([every], "file").orderBy("rank").collect()]
    assert got == ["conflicting_duplicate", "measure_column_not_numeric", "text_in_measure", "mismatched_id", "duplicate_rows", "separator_rows", "empty_columns", "sparse_columns"]
    labels = ["Failures", "Skipped", "Blocked", "N/A", "Not run", "testcases", "Total hours", "cases"]
    cols = spark.createDataFrame([("f", i, f"c{i}", x, "string") for i, x in enumerate(labels)], "file string, pos int, key string, label string, type string")
    cells = spark.createDataFrame([("f", 1, f"c{i}", "word", None) for i in range(8)], "file string, row_index int, key string, s string, n double")
    told = Q.measure_warnings(Q.column_fill(cells, "file"), cols, "file").collect()
    assert sorted(r.message.split(" is named")[0] for r in told) == sorted(labels[:-1])


def test_read_grid(spark, tmp_path):
    rec = spark.createDataFrame([("a", "r", "l", "s1", 1), ("a", "r", "l", "s2", 2)], "app string, release string, layer string, snapshot_id string, n int")
    assert rows_of(X.without_snapshots(rec, rec.filter("snapshot_id = 's1'")), "n") == [(2,)]
    (tmp_path / "g.csv").write_text("a,b\n1,2\n")
    assert [r.cells for r in X.read_grid(spark, str(tmp_path / "g.csv"), "csv").orderBy("row_no").collect()] == [["a", "b"], ["1", "2"]]
    (tmp_path / "q.csv").write_text('\ufeff"x, y","say ""hi""",\r\n\r\n,"two\nlines",z\n')
    assert [r.cells for r in X.read_grid(spark, str(tmp_path / "q.csv"), "csv").orderBy("row_no").collect()] == [["x, y", 'say "hi"'], [None, "two\nlines", "z"]]
