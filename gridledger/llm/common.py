"""Helpers that the training-data operators share: shared-folder tables and task-side files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents are held whole in a task, so batches are small.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process (local, local[8], but not local-cluster[...])."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is absent (local tests), a temporary folder of this session is used."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridledger-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _set(spark: SparkSession, **values: str):
    """Settings of the session for a while; names are without `spark.sql.`, with two underscores for a dot."""
    names = {k: f"spark.sql.{k.replace('__', '.')}" for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if before[k] is None else spark.conf.set(n, before[k])


def shuffles_end_with_their_job(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of a query when the query ends."""
    return _set(spark, classic__shuffleDependency__fileCleanup__enabled="true")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    Python tasks get at most BATCH_BYTES at a time (and one row at least), as texts can be long."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_end_with_their_job(spark), _set(spark, execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gl_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table._gl_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written to the shared folder."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_gridledger_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="gridledger-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._gridledger_shipped = True


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to all tasks; returns the name by which local_file finds it."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_gridledger_files", {})
    if path not in sent:
        sc.addFile(path)
        sent[path] = os.path.basename(path)
    return sent[path]


def local_file(name: str) -> str:
    """Where a task finds a file that was sent."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def arrow_map(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """mapInArrow with the package sent along."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def bytes_of(text: Column | None = None) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary")


def id_keys(doc_id: Column | None = None) -> list[Column]:
    """doc_id as two columns without nulls, to join and group by."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_gl_id"), doc_id.isNull().alias("_gl_no_id")]


def open_fs(uri: str):
    """(file system, path) of a URI, for tasks that read or write shared files themselves."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces_of(batch):
    """Small slices of an Arrow batch, so that its Python objects stay few."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def ranked(df: DataFrame, group: list[str], order: list[Column], fine: Column, value: Column, coarse: int = 4096) -> DataFrame:
    """Add `before`: the sum of `value` over the rows of the group that come earlier.

    `fine` is a long in [0, 2^32) that rises with the order. A group is cut into `coarse` ranges of
    it, so that a group with a third of all rows is summed by many tasks: a window within each
    range, and one over the (at most `coarse`) sums of ranges."""
    from pyspark.sql import Window

    cut = df.withColumn("_range", (F.floor(fine * F.lit(coarse) / F.lit(1 << 32))).cast("int")).withColumn("_value", value)
    keys = [F.col(g) for g in group]
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("_within", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_range") == F.col("_r")]
    joined = within.join(starts, on, "inner")
    return joined.withColumn("before", F.col("_start") + F.col("_within")).drop("_range", "_value", "_r", "_start", "_within", *[f"_{g}" for g in group])
