"""One column of one sheet may hold nearly all cells: it must not be one task's work."""

from pyspark.sql import functions as F

from gridledger.operators import dashboards as D

COLUMNS = "snapshot_id string, pos int, key string, label string, type string"
THREE = [("s", 0, "a", "Name", "string"), ("s", 1, "b", "State", "string"), ("s", 2, "c", "Test Count", "number")]


def cells_of(spark, n=4000):
    rows = spark.range(n).select("id", F.lit("x").alias("section"), F.concat(F.lit("QX-"), "id").alias("a"), F.when(F.col("id") % 2 == 0, "Passed").otherwise("Failed").alias("b"), (F.col("id") % 7).alias("c"))
    return D.cells_of(rows, F.lit("s"), "section", "id", ["a", "b"], ["c"]), spark.createDataFrame(THREE, COLUMNS)


def before_join(df, kind):
    """Whether cells are aggregated, or cut by a broadcast table, before they meet the table of columns by a shuffle."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [k for k, line in enumerate(lines) if "SortMergeJoin" in line and kind in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k in at:
        below = [line for j, line in enumerate(lines[k + 1 :], k + 1) if all(depth(x) > depth(lines[k]) for x in lines[k + 1 : j + 1])]
        if any("Generate explode" in line for line in below) and not any("Aggregate" in line or "BroadcastHashJoin" in line for line in below[: next(i for i, line in enumerate(below) if "Generate explode" in line)]):
            return False
    return True


def test_values_are_counted_before_they_meet_columns(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells, columns = cells_of(spark)
        stats = D.column_stats(cells, columns)
        assert before_join(stats, "LeftSemi")
        got = {r.key: (r["distinct"], r.filled, r.outcomes, r.identifiers, len(r["values"])) for r in stats.collect()}
        assert got == {"a": (4000, 4000, 0, 4000, 25), "b": (2, 4000, 2, 0, 2)}
        dims = D.rank_dimensions(columns, stats, cells.select("snapshot_id").distinct().withColumn("n_rows", F.lit(4000)))
        named = D.label_columns(columns, dims, cells)
        assert before_join(named, "LeftSemi") and named.first().labels == ["a", "b"]
        # cells that do not know their type give the same
        assert {r.key: r.filled for r in D.column_stats(cells.drop("type"), columns).collect()} == {"a": 4000, "b": 4000}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_largest_rows_leave_cells_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells, columns = cells_of(spark)
        current = spark.createDataFrame([("s", 1)], "snapshot_id string, created_at int")
        top = D.merged_top_rows(cells, columns, current)
        assert before_join(top, "Inner") and before_join(top, "LeftSemi")
        assert [(r.row_index, r.value, r.label) for r in top.orderBy("rank").limit(2).collect()] == [(6, 6.0, "QX-6 · Passed"), (13, 6.0, "QX-13 · Failed")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
