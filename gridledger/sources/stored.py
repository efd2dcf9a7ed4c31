"""Stored snapshots that can be loaded, corrected, moved and deleted, and each of these done again after a stop.

Below a root lie two Parquet tables. `records` has a partition for each snapshot, which a load owns: running it again
replaces what it wrote. `snapshots` has a row for each, in partitions by scope (app, release, layer), which a change
rewrites from a settled copy. Rows count only once their snapshot has its row, so what a stopped load or delete left
in `records` is never read. Both use Spark's dynamic partition overwrite: partitions without new rows stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridledger.sources.kept import kept, remove

SCOPE = ["app", "release", "layer"]
PARTITIONS = [*SCOPE, "snapshot_id"]


def _replace(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Write the partitions that df has rows of in place of what is there; a hot one is split among tasks."""
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame:
    """A table whose partition values are texts as they were written (Spark would read 007 as a number)."""
    found = spark.read.parquet(path).schema
    texts = [StructField(f.name, StringType()) if f.name in partitions else f for f in found.fields]
    return spark.read.schema(StructType(texts)).parquet(path)


def drop_partitions(spark: SparkSession, path: str, gone: DataFrame, partitions: list[str] = PARTITIONS) -> None:
    """Delete partitions, given by their values, from a table's folder. They are named by a user or a load, so they are few."""
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for r in gone.select(*[F.col(c).cast("string") for c in partitions]).distinct().toLocalIterator():
        remove(spark, "/".join([path, *[escaped.getPartitionPathString(c, r[c]) for c in partitions]]))


def stored_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/snapshots", SCOPE)


def stored_records(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the snapshots that are there."""
    known = stored_snapshots(spark, root).select(*PARTITIONS)
    return _read(spark, f"{root}/records", PARTITIONS).join(known, PARTITIONS, "left_semi")


def load_snapshots(root: str, snapshots: DataFrame, records: DataFrame) -> None:
    """Store snapshots with their rows: first the rows, then, when all are there, the snapshots.

    snapshots: a row each, with app, release, layer, snapshot_id; records: their rows, with the same columns. Snapshots
    of the same id are replaced, rows included; without rows, those that were there go."""
    spark = snapshots.sparkSession
    as_texts = lambda df: df.withColumns({c: F.col(c).cast("string") for c in PARTITIONS})
    snapshots = kept(as_texts(snapshots))
    _replace(as_texts(records), f"{root}/records", PARTITIONS)
    empty = snapshots.select(*PARTITIONS).join(as_texts(records.select(*PARTITIONS)), PARTITIONS, "left_anti")
    drop_partitions(spark, f"{root}/records", empty)
    new = snapshots
    if _exists(spark, f"{root}/snapshots"):
        old = stored_snapshots(spark, root).join(snapshots.select(*SCOPE).distinct(), SCOPE, "left_semi")
        new = kept(snapshots.unionByName(old.join(snapshots.select(*PARTITIONS), PARTITIONS, "left_anti"), allowMissingColumns=True))
    _replace(new, f"{root}/snapshots", SCOPE)


def change_snapshots(spark: SparkSession, root: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite the rows of the touched scopes (app, release, layer); those that have no row left are dropped."""
    scopes = kept(touched.select(*[F.col(c).cast("string").alias(c) for c in SCOPE]).distinct())
    new = kept(change(stored_snapshots(spark, root).join(scopes, SCOPE, "left_semi")))
    _replace(new, f"{root}/snapshots", SCOPE)
    drop_partitions(spark, f"{root}/snapshots", scopes.join(new, SCOPE, "left_anti"), SCOPE)


def correct_periods(spark: SparkSession, root: str, fixes: DataFrame) -> None:
    """fixes: app, release, layer, snapshot_id, new_period."""
    change = lambda s: s.join(fixes.select(*PARTITIONS, "new_period"), PARTITIONS, "left").withColumn("period", F.coalesce("new_period", "period")).drop("new_period")
    change_snapshots(spark, root, fixes, lambda s: change(s).select(*s.columns))


def move_files(spark: SparkSession, root: str, renames: DataFrame) -> None:
    """Move series to new names. renames: app, release, layer, file, new_file; one that is done already finds no file."""
    change = lambda s: s.join(renames.select(*SCOPE, "file", "new_file"), [*SCOPE, "file"], "left").withColumn("file", F.coalesce("new_file", "file"))
    change_snapshots(spark, root, renames, lambda s: change(s).select(*s.columns))


def delete_snapshots(spark: SparkSession, root: str, gone: DataFrame) -> None:
    """Delete snapshots (app, release, layer, snapshot_id): first their rows in `snapshots`, so that they no longer count."""
    gone = kept(gone.select(*[F.col(c).cast("string").alias(c) for c in PARTITIONS]).distinct())
    change_snapshots(spark, root, gone, lambda s: s.join(gone, PARTITIONS, "left_anti").select(*s.columns))
    drop_partitions(spark, f"{root}/records", gone)
