from pyspark.sql import functions as F

from gridledger.sources.kept import kept


def test_tables_of_many_sheets_are_not_broadcast(spark):
    """A small file of many rows is a large table in memory: 18 million bytes of rows in a file of under 1.5 million."""
    sheets = lambda: spark.range(300_000).select(F.col("id").cast("string").alias("file"), F.lit("a label that all sheets have").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
    try:
        table = kept(sheets())
        size = sum(f.stat().st_size for f in _files(table))
        joined = kept(sheets()).join(table.withColumnRenamed("label", "other"), "file")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert size < 10 << 20 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _files(df):
    from pathlib import Path
    from urllib.parse import urlparse

    return [Path(urlparse(f).path) for f in df.inputFiles()]
