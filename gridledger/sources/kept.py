"""Tables that are read more than once in a job, kept as Parquet in the folder that driver and executors share.

Parquet keeps columns and filters prunable, gives the planner sizes, and cuts the lineage. What a session keeps
lies in one folder of its own below spark.checkpoint.dir, which goes when the session ends or `drop_kept` is called."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes in memory for a byte of Parquet, as the planner is to assume.
IN_MEMORY = 20.0


def shared_folder(spark: SparkSession) -> str:
    """The folder of the setting spark.checkpoint.dir; one is made only where the setting is absent, as in local tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridledger-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever its file system is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def session_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if (found := getattr(sc, "_gridledger_kept", None)) is None:
        found = sc._gridledger_kept = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex[:12]}"
        atexit.register(drop_kept, spark)  # runs before the context stops
    return found


def drop_kept(spark: SparkSession) -> None:
    """Delete all that the session keeps; tables read from it are void."""
    sc = spark.sparkContext
    if getattr(sc, "_gridledger_kept", None) and sc._jsc is not None:
        remove(spark, sc._gridledger_kept)
        sc._gridledger_kept = None


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the session, for files that one of its jobs writes and another reads."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def honest_sizes(spark: SparkSession) -> None:
    """Let the planner count a Parquet file as what it is in memory, unless the session says otherwise.

    A row of short repeated texts takes a byte or two of a file and over a hundred of a broadcast table, so tables of a
    row a sheet would be sent to every executor, many at a time."""
    if spark.conf.get(FACTOR, None) in (None, "1.0"):
        spark.conf.set(FACTOR, str(IN_MEMORY))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the session's folder."""
    spark = df.sparkSession
    honest_sizes(spark)
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
