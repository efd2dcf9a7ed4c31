from pyspark.sql import functions as F

from gridledger.operators import dashboards as D

COLUMNS = "snapshot_id string, pos int, key string, label string, type string"


def sheet(spark, values, label="State"):
    cells = spark.createDataFrame([("s", "x", i, 0, "a", v, None) for i, v in enumerate(values)], "snapshot_id string, section string, row_index int, pos int, key string, s string, n double")
    columns = spark.createDataFrame([("s", 0, "a", label, "string")], COLUMNS)
    return cells, columns, cells.groupBy("snapshot_id").agg(F.count("*").alias("n_rows"))


def test_all_values_decide(spark):
    """More values than are shown: 25 names that sort first, and 30 spellings of outcomes."""
    spelled = [f"Passed{'.' * i}" for i in range(1, 16)] + [f"Failed{'!' * i}" for i in range(1, 16)]
    cells, columns, n = sheet(spark, [f"A{chr(97 + i)} name" for i in range(25)] + spelled)
    stats = D.column_stats(cells, columns)
    row = stats.first()
    assert (row["distinct"], row.outcomes, row.identifiers, len(row["values"])) == (55, 30, 0, 25)
    assert D.detect_status_column(columns, stats, n).first().status == "a"
    fewer = D.column_stats(*sheet(spark, [f"A{i} name" for i in range(31)] + spelled)[:2])
    assert D.detect_status_column(columns, fewer, n).count() == 0


def test_an_inventory_by_all_values(spark):
    cells, columns, _ = sheet(spark, [f"note {chr(97 + i)}" for i in range(26)] + [f"QX-{i}" for i in range(26)])
    assert D.detect_inventory(columns, D.column_stats(cells, columns)).first().id_column == "a"
    cells, columns, _ = sheet(spark, [f"z {chr(97 + i)}" for i in range(26)] + [f"QX-{i}" for i in range(25)])
    assert D.detect_inventory(columns, D.column_stats(cells, columns)).count() == 0
