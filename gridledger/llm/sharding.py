"""Sharding by vector bin packing over bytes, words and rows.

Equal texts form a group. A group goes to one shard whole unless it holds more than 3/4 of a shard's
bytes; then it is split into as many parts of at most about 3/4 as it needs. Groups over 1/1024 of a
shard's bytes or rows (at most 2 * 1024 * shards of them) are placed one by one. Those over 1/64 are also
summed and ranked in `CELLS` cells by doc_id, of which parts are made; so no task ranks a large group.
Smaller groups are gathered by hash into at most `bundles` bundles, which are placed like groups. Groups and
bundles, largest first, go to the shard where the dot product of their share of the totals with the shard's
residual capacity is highest (ties: equal ones by hash; equal shards by number). Only their sums reach the
driver. Slots come from the cell's place in its shard and the row's rank in its cell, so no task sorts a
whole shard. Where the parts of split groups are more than the shards, parts are single cells, for evenness.

The law that holds is `bytes`: shards' sizes are nearly equal; bytes weigh more than words and rows.

Defined results: a null text is a group of its own with 0 bytes, equal to no empty text; rows that repeat
doc_id and text stay together; a null doc_id sorts first; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm import common

SHARDS = 24
#: Hash bundles of small groups.
BUNDLES = 1 << 14
#: A group with more than this part of a shard is placed by itself.
SINGLE_SHARE = 1 / 1024
#: A group with more than this part of a shard is summed and ranked in cells.
CELL_SHARE = 1 / 64
CELLS = 64
#: A group with more than this part of a shard's bytes is split.
WHOLE_SHARE = 3 / 4
#: What bytes, words and rows weigh in the dot product: most of all bytes, whose law holds.
PULL = (60.0, 1.0, 1.0)
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def _measured(batches):
    for batch in batches:
        for part in common.pieces_of(batch):
            words = [0 if x is None else len(x.split()) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(words, pa.int64())], names=["doc_id", "size", "text_crc32", "grp", "words"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, grp (hash of the text), words of every row, without texts."""
    body = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), F.col("text")).alias("grp"),
    )
    return common.arrow_map(rows, _measured, "doc_id long, size long, text_crc32 long, grp long, words long")


def pack(sums: np.ndarray, shards: int = SHARDS, pull: tuple[float, ...] = PULL) -> np.ndarray:
    """The shard of each row of sums (bytes, words, rows), by the highest dot product with residual capacity."""
    if not len(sums):
        return np.zeros(0, np.int64)
    total = np.maximum(sums.sum(axis=0), 1)
    need = sums / total * shards * np.asarray(pull)
    size = sums / total * shards
    left = np.ones((shards, sums.shape[1]))
    out = np.zeros(len(sums), np.int64)
    for k in np.lexsort((np.arange(len(sums)), -need.sum(axis=1))):
        at = int(np.argmax(left @ need[k]))
        out[k] = at
        left[at] -= size[k]
    return out


def parts_of(bundles: list[int], cells: list[int], sizes: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The part that each row of sums goes with, as a number; rows come sorted by bundle and cell. Cells of one group
    (cell 0 or more) are one part if it is at most WHOLE_SHARE of a shard, else as few as keep to that."""
    most = max(sizes.sum() / shards * WHOLE_SHARE, 1)
    first = np.array([k == 0 or bundles[k] != bundles[k - 1] or cells[k] < 0 or cells[k - 1] < 0 for k in range(len(bundles))], bool)
    starts = np.append(np.nonzero(first)[0], len(bundles)).tolist()
    need = [max(1, int(np.ceil(sizes[a:b].sum() / most))) for a, b in zip(starts, starts[1:])]
    fine = sum(n for n in need if n > 1) > shards
    out, at = np.zeros(len(bundles), np.int64), 0
    for a, b, n in zip(starts, starts[1:], need):
        if n > 1 and (fine or n >= b - a):
            inner = np.arange(b - a)
        else:
            ends = np.cumsum(sizes[a:b])
            inner = np.unique(np.minimum(((ends - sizes[a:b] / 2) * n / max(ends[-1], 1)).astype(np.int64), n - 1), return_inverse=True)[1]
        out[a:b] = at + inner
        at = int(out[b - 1]) + 1
    return out


def shard(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    rows = common.settle(measured(docs), "shard-rows")
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    groups = rows.groupBy("grp").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    over = lambda share: (F.col("b") > whole.b / shards * share) | (F.col("n") > max(1.0, whole.n / shards * share))
    # at most 2 * shards / SINGLE_SHARE groups can be over a limit, so this is small at any size
    single = groups.filter(over(SINGLE_SHARE)).select(F.col("grp").alias("_single"), (over(CELL_SHARE) & (F.col("n") > 1)).alias("_cells"))
    rows = rows.join(F.broadcast(single), F.col("grp") == F.col("_single"), "left")
    cell = F.when(F.col("_single").isNull(), -2).when(F.col("_cells"), F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")).otherwise(-1)
    rows = rows.withColumn("cell", cell).withColumn("bundle", F.coalesce("_single", F.pmod("grp", F.lit(bundles))))
    keys = ["bundle", "cell"]
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("n")).orderBy(*keys).collect()
    vectors = np.array([[r.b, r.w, r.n] for r in sums], dtype=np.float64).reshape(-1, 3)
    part_no = parts_of([r.bundle for r in sums], [r.cell for r in sums], vectors[:, 0], shards)
    packed = np.zeros((int(part_no[-1]) + 1 if len(sums) else 0, 3))
    np.add.at(packed, part_no, vectors)
    place, starts, seen = pack(packed, shards)[part_no], [], [0] * shards
    for r, at in zip(sums, place):
        starts.append((r.bundle, r.cell, int(at), seen[at]))
        seen[at] += r.n
    # as many rows as sums, which are bounded
    placed = F.broadcast(spark.createDataFrame(starts, "bundle long, cell int, shard int, start long"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("grp", "doc_id", "size")) - 1
    out = rows.withColumn("_rank", rank).join(placed, keys)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.docs_of(spark, sf_dir))
