"""Loading sheet grids as they arrive: a file stream whose state knows each file's latest content.

What a file holds is told by the sums of its rows' digests, so that a row of any file needs constant memory. State tells
each file's latest content: content that is the latest already gives nothing, other content the next sequence. It is
keyed by buckets of files, as a call for each file costs more than its rows do; a bucket that changed is written whole. Only files of new
content are read and loaded, by the batch job. Stream and state are kept in the checkpoint folder; a batch that is run
again writes to the same folders."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gridledger.operators import ingest
from gridledger.sources.kept import kept

GRID = "file string, row_no int, cells array<string>"
#: Buckets of files. A stream that has begun keeps its number.
BUCKETS = 4096
#: Words of a row's digest.
WORDS = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "file string, path string, content_hash string, sequence long, row_count long"


def row_words(grid: DataFrame) -> DataFrame:
    """grid's file and path with w0...: the words of the SHA-256 of each row's place and cells."""
    digest = F.sha2(F.to_json(F.struct("row_no", "cells"), {"ignoreNullFields": "false"}), 256)
    rows = grid.select("file", "path", digest.alias("_h"))
    return rows.select("file", "path", *[F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"w{k}") for k in range(WORDS)])


def content_hash(sums: list[int], rows: int) -> str:
    return "".join(f"{s % (1 << 64):016x}" for s in sums) + f"-{rows}"


def contents(grid: DataFrame) -> DataFrame:
    """file, content_hash, row_count of a batch's grid (file, row_no, cells): what the stream's state compares."""
    rows = row_words(grid.withColumn("path", F.lit("")))
    sums = rows.groupBy("file").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(WORDS)], F.count("*").alias("row_count"))
    words = F.concat(*[F.lpad(F.lower(F.hex(f"w{k}")), 16, "0") for k in range(WORDS)])
    return sums.select("file", F.concat_ws("-", words, F.col("row_count").cast("string")).alias("content_hash"), "row_count")


class Series(StatefulProcessor):
    """Files' versions: the rows of a bucket of files in, a row for each path of each file whose content is new out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "files array<string>, hashes array<string>, sequences array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        sums, paths = {}, {}  # of a file: its words' sums and its rows, and its paths
        for part in rows:
            places, files = pd.factorize(part["file"], use_na_sentinel=False)
            order = np.argsort(places, kind="stable")
            begin = np.flatnonzero(np.diff(places[order], prepend=-1))
            words = part[[f"w{k}" for k in range(WORDS)]].to_numpy()[order]
            told = np.column_stack([np.add.reduceat(words, begin), np.diff(begin, append=len(order))]).tolist()
            for file, more in zip(files, told):
                file = file if isinstance(file, str) else None  # a null is nan here
                sums[file] = [x + y for x, y in zip(sums[file], more)] if file in sums else more
            for file, path in set(zip(part["file"], part["path"])):
                paths.setdefault(file, set()).add(path)
        known = {f: (h, n) for f, h, n in zip(*self.latest.get())} if self.latest.exists() else {}
        new = {}
        for file, (*told, n) in sums.items():
            found, (before, sequence) = content_hash(told, n), known.get(file, (None, 0))
            if found != before:
                new[file] = (found, sequence + 1, n)
        if new:
            known.update({f: told[:2] for f, told in new.items()})
            self.latest.update((list(known), [h for h, _ in known.values()], [n for _, n in known.values()]))
            out = [(f, p, *new[f]) for f in new for p in sorted(paths[f])]
            yield pd.DataFrame(out, columns=["file", "path", "content_hash", "sequence", "row_count"])

    def close(self) -> None:
        pass


def changes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files below `path` (Parquet of GRID) that have new content: file, path, content_hash, sequence,
    row_count, a row for each path that holds rows of it. A sheet arrives within one batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    reader = spark.readStream.schema(GRID)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = row_words(reader.parquet(path).select("*", F.col("_metadata.file_path").alias("path")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Series(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def load_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Load all grid files below `path` that are new since the last run and hold new content, then stop.

    Tables snapshots, data, columns and rejects get a folder for each batch, which a batch that is run again replaces."""

    def write(changed: DataFrame, batch: int) -> None:
        changed = kept(changed)
        paths = [r.path for r in changed.select("path").distinct().collect()]  # of one batch, which the stream's driver lists too
        if not paths:
            return
        own = changed.select("file", "content_hash", "sequence", "row_count").distinct()
        grid = spark.read.schema(GRID).parquet(*paths).join(own.select("file"), "file", "left_semi")
        parts = ingest.load(grid) | {"snapshots": own}
        for name in ("data", "columns", "rejects", "snapshots"):
            told = parts[name] if name == "snapshots" else parts[name].join(own.select("file", "sequence"), "file")
            told.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{name}/batch_{batch}")

    return changes(spark, path, files_per_batch).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
