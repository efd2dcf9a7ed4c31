"""Sources and sinks: grids, manifests of files, changes of snapshots, CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.sources.kept import kept

SUFFIXES = ("xlsx", "xlsm")
MAX_FILES, MAX_DEPTH, MAX_BYTES = 200, 2, 5 << 20


CSV = {"header": "false", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8", "maxColumns": "1000000"}


def csv_width(spark: SparkSession, path: str) -> int:
    """No fewer than the cells of any record below a path: Spark's reader gives records that aren't one cell whole, and
    their commas are counted."""
    raw = spark.read.options(**CSV, columnNameOfCorruptRecord="_raw").schema("_cell string, _raw string").csv(path)
    commas = F.length("_raw") - F.length(F.replace("_raw", F.lit(","), F.lit("")))
    return 1 + (raw.agg(F.max(F.coalesce(commas, F.length("_cell") * 0))).first()[0] or 0)


def csv_grid(spark: SparkSession, path: str, file: Column | None = None) -> DataFrame:
    """file, row_no, cells of the CSV files below a path, by Spark's reader: quoted cells hold commas, quotes and line
    ends, a quote within an unquoted cell is a character, empty lines are none and empty cells null.

    A file is read by one task in its order, and row_no counts its records from 0. file: from `_metadata.file_path`."""
    width = csv_width(spark, path)
    names = [f"c{i}" for i in range(width)]
    rows = spark.read.options(**CSV).schema(", ".join(f"{c} string" for c in names)).csv(path)
    at = F.col("_metadata.file_path")
    rows = rows.select((at if file is None else file).alias("file"), F.monotonically_increasing_id().alias("_id"), F.array(*names).alias("cells"))
    last = F.array_max(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))  # records have as many cells as their last filled one
    rows = kept(rows.withColumn("cells", F.slice("cells", 1, last)))
    first = rows.groupBy("file").agg(F.min("_id").alias("_first"))
    return rows.join(first, "file").filter(F.size("cells") > 0).select("file", (F.col("_id") - F.col("_first")).cast("int").alias("row_no"), "cells")


def read_grid(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A decoded sheet grid: file, row_no, cells. CSV files keep their record order within a file."""
    if form in ("parquet", "json"):
        return spark.read.format(form).schema("file string, row_no int, cells array<string>").load(path)
    return csv_grid(spark, path)


def scan_files(spark: SparkSession, path: str, root: Column, release: Column, suffixes: tuple[str, ...] = SUFFIXES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The manifest of the files below a folder. Names and sizes come from the listing; only files of the suffixes and of
    at most max_bytes are opened, for their hash."""
    each = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(each) + "}").load(path)
    listed = file_manifest(found.select("path", "modificationTime", "length"), root, release, suffixes, max_bytes=max_bytes)
    hashes = found.filter(F.col("length") <= max_bytes).select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_hash"))
    return listed.join(hashes, "_path", "left").withColumn("file_hash", F.col("_hash")).drop("_path", "_hash")


def file_manifest(files: DataFrame, root: Column, release: Column, suffixes: tuple[str, ...] = SUFFIXES, most: int = MAX_FILES, depth: int = MAX_DEPTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """release, path, name, stem, folder, size, modified, file_hash (null without `content`), error of the files that count as workbooks.

    Hidden and lock files are left out, as are other suffixes and deeper folders; files over the size, and all
    but the first `most` files of a release by path, are listed with an error."""
    rel = F.regexp_replace(F.expr("substring(path, 1)"), "^file:/*", "/")
    out = files.withColumn("release", release).withColumn("_rel", F.regexp_replace(F.substr(rel, F.length(root) + 1), "^/+", ""))
    out = out.withColumn("name", F.substring_index("_rel", "/", -1)).withColumn("_levels", F.size(F.split("_rel", "/")))
    out = out.filter(F.lower(F.substring_index("name", ".", -1)).isin(*suffixes) & ~F.col("name").rlike(r"^(~\$|\.)") & (F.col("_levels") <= depth))
    folder = F.when(F.col("_levels") > 1, F.element_at(F.split("_rel", "/"), -2))
    out = out.select("release", F.col("_rel").alias("path"), "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), folder.alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), (F.sha2("content", 256) if "content" in files.columns else F.lit(None).cast("string")).alias("file_hash"), *([] if "content" in files.columns else [F.col("path").alias("_path")]), F.when(F.col("length") > max_bytes, "file_too_large").alias("error"))
    place = F.row_number().over(Window.partitionBy("release").orderBy("path"))
    return out.withColumn("_n", place).withColumn("error", F.when(F.col("_n") > most, "too_many_files").otherwise(F.col("error"))).drop("_n")


def without_snapshots(records: DataFrame, gone: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """records without those of the given snapshots."""
    return records.join(gone.select(key).distinct(), key, "left_anti")


def set_period(snapshots: DataFrame, fixes: DataFrame) -> DataFrame:
    """snapshots with the periods of fixes (snapshot_id, new_period) where there is one."""
    return snapshots.join(fixes, "snapshot_id", "left").withColumn("period", F.coalesce("new_period", "period")).drop("new_period")


def move_series(snapshots: DataFrame, renames: DataFrame) -> DataFrame:
    """snapshots with files moved to their new names: renames has layer, file, new_file."""
    return snapshots.join(renames, ["layer", "file"], "left").withColumn("file", F.coalesce("new_file", "file")).drop("new_file")


def numbered(rows: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """rows with their place, from 1, in the global order: Spark samples the order, cuts it into ranges and sorts each,
    and a row's place is its range's offset and its place within. Only the ranges' sizes, a row each, are ranked together."""
    each = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    each = kept(each.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at") - F.shiftleft("_part", 33)))
    sizes = each.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return each.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None, drop: tuple[str, ...] = ()) -> None:
    """rows as CSV; with an order, the parts follow each other in it, read by name. `drop`: columns that only order."""
    ordered = rows.orderBy(*order) if order else rows
    ordered.drop(*drop).write.mode("overwrite").option("header", "true").csv(path)
