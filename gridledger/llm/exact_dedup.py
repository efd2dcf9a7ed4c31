"""Exact dedup by an extendible-hash index on shared files.

1. Directory. Every different hash has a load, the bytes of its rows. The directory starts at the depth
   at which the load could just fit; a bucket over the capacity is split by one more bit of the hash, and
   a split below the global depth doubles the directory, on and on up to all 64 bits. A hash that is over
   the capacity by itself (many copies of one text, or one huge text) cannot be split; it is a bucket of
   its own with overflow pages, dealt by doc_id. Loads, splits and entries are tables, none is collected.
2. Index. Rows go to shared files, one folder for each page of a bucket.
3. Owner tasks read the pages of their key ranges. Each hash has a chain of different texts, compared
   byte by byte; the chain's place is the class of a row, and the owner gives its largest doc_id, its size
   and the row that stays. Memory: the different texts of one page, and two numbers for each row.
4. Only the overflow pages of one hash have classes in common. Each page hands on one text for each class;
   these meet by their bytes, and the pages' rows take the class they become. No digest decides anything.

Defined results: a null text counts as empty; texts of any length are compared whole; of rows that
repeat one doc_id and text, one stays; a null doc_id ranks below all others; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common

#: Bytes of text in a bucket or page.
CAPACITY = 32 << 20
#: What a row takes besides its text.
ROW_BYTES = 64
#: Bits by which buckets can be split before the cells are counted anew.
FINER_BITS = 4
#: Up to so many directory entries are sent to all tasks; more are joined.
SENT_ENTRIES = 1_000_000
CLASSES = "doc_id long, bucket string, page int, place int, first boolean, keep_id long, group_size long, text_sha256 string, overflow boolean, body binary"


def prefix(key: str, bits: int) -> Column:
    """The first bits of a hash, as a long; all hashes have the same 0 bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(loads: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, int]:
    """((cell, bucket), depth) of hashes with loads (key, load) of at most the capacity each.

    A cell is the first `depth` bits of a hash; its bucket is the largest range around it within the capacity."""
    total = loads.agg(F.sum("load")).first()[0] or 0
    low = min(max(0, math.ceil(math.log2(max(1.0, total / capacity)))), key_bits)
    high = low
    while True:
        high = min(high + FINER_BITS, key_bits)
        cells = common.settle(loads.groupBy(prefix("key", high).alias("cell")).agg(F.sum("load").alias("load")), "exact-cells")
        if high == key_bits or cells.filter(F.col("load") > capacity).isEmpty():
            break
        common.discard(cells)
    range_ = F.expr(f"shiftrightunsigned(cell, cast({high} - bits AS int))")
    each = cells.select("cell", "load", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("bits")).withColumn("range", range_)
    fits = each.groupBy("bits", "range").agg(F.sum("load").alias("load")).filter((F.col("load") <= capacity) | (F.col("bits") == high)).select("bits", "range")
    found = each.join(fits, ["bits", "range"]).groupBy("cell").agg(F.min(F.struct("bits", "range")).alias("b"))
    return common.settle(found.select("cell", F.concat_ws("-", F.lit("range"), "b.bits", F.hex("b.range")).alias("bucket")), "exact-directory"), high


def _own(root: str):
    fields = pa.schema([("doc_id", pa.int64()), ("bucket", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("first", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("overflow", pa.bool_()), ("body", pa.binary())])

    def page_of(fs, base: str, bucket: str, page: int, overflow: bool):
        from pyarrow.fs import FileSelector

        chains: dict[int, list[tuple[bytes, int]]] = {}
        bodies: list[bytes] = []
        ids, places = [], []
        for info in fs.get_file_info(FileSelector(f"{base}/bucket={bucket}/page={page}", allow_not_found=True)):
            if not info.path.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as f:
                for part in pq.ParquetFile(f).iter_batches(batch_size=common.BATCH_ROWS, columns=["doc_id", "key", "body"]):
                    at = np.zeros(part.num_rows, np.int32)
                    for k, (key, body) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                        chain = chains.setdefault(key, [])
                        found = next((c for text, c in chain if text == body), None)
                        if found is None:
                            found = len(bodies)
                            chain.append((body, found))
                            bodies.append(body)
                        at[k] = found
                    ids.append(part.column(0))
                    places.append(at)
        if not places:
            return
        place = np.concatenate(places)
        id_ = pa.chunked_array(ids).combine_chunks()
        null = id_.is_null().to_numpy(zero_copy_only=False)
        number = id_.fill_null(0).to_numpy(zero_copy_only=False)
        # by class, then nulls before ids, then id: the last of a class stays
        order = np.lexsort((number, ~null, place))
        last = order[np.append(np.nonzero(np.diff(place[order]))[0], len(order) - 1)]
        size = np.bincount(place, minlength=len(bodies))
        first = np.zeros(len(place), bool)
        first[last] = True
        sha = np.array([hashlib.sha256(b).hexdigest() for b in bodies], object)
        for a in range(0, len(place), 50_000):
            p = place[a : a + 50_000]
            n, keep = len(p), last[p]
            shown = pa.array([bodies[c] if overflow and is_first else None for c, is_first in zip(p.tolist(), first[a : a + n].tolist())], pa.binary())
            yield pa.record_batch([
                id_.slice(a, n), pa.array([bucket] * n), pa.array(np.full(n, page, np.int32)), pa.array(p), pa.array(first[a : a + n]),
                pa.array(number[keep], pa.int64(), mask=null[keep]), pa.array(size[p].astype(np.int64)), pa.array(sha[p].tolist(), pa.string()), pa.array(np.full(n, overflow)), shown,
            ], schema=fields)

    def run(batches):
        fs, base = common.open_fs(root)
        for batch in batches:
            for bucket, page, overflow in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                yield from page_of(fs, base, bucket, page, overflow)

    return run


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, body, key of every row; tests put other hashes in its place."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.bytes_of().alias("body"))
    return base.withColumn("key", F.xxhash64(F.col("body").cast("string")))


def build_index(base: DataFrame, capacity: int = CAPACITY) -> tuple[str, DataFrame]:
    """Write the index files of rows (doc_id, body, key); returns their folder and its pages (bucket, page, overflow)."""
    spark = base.sparkSession
    loads = common.settle(base.groupBy("key").agg(F.sum(F.octet_length("body") + ROW_BYTES).alias("load")), "exact-loads")
    over = loads.filter(F.col("load") > capacity)
    entries, depth = directory(loads.filter(F.col("load") <= capacity), capacity)
    # hashes over the capacity are at most the corpus by the capacity, fewer than the entries
    alone = over.select("key", F.concat(F.lit("hash-"), F.hex("key")).alias("_alone"), F.ceil(F.col("load") / F.lit(capacity)).cast("int").alias("pages"))
    alone = common.settle(alone, "exact-alone")
    sent = entries.count() + alone.count() <= SENT_ENTRIES
    near = F.broadcast if sent else (lambda t: t)
    rows = base.join(near(alone), "key", "left").withColumn("cell", prefix("key", depth)).join(near(entries), "cell", "left")
    dealt = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("page", F.when(F.col("pages").isNull(), 0).otherwise(F.pmod(dealt, F.col("pages"))).cast("int")).withColumn("bucket", F.coalesce("_alone", "bucket"))
    pages = entries.select("bucket", F.lit(1).alias("pages"), F.lit(False).alias("overflow")).distinct().union(alone.select(F.col("_alone").alias("bucket"), "pages", F.lit(True).alias("overflow")))
    pages = common.settle(pages.select("bucket", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), "overflow"), "exact-pages")
    path = common.new_path(spark, "exact-index")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pages.count(), 100_000))
    dealt = rows.select("doc_id", "key", "body", "bucket", "page").repartition(n, "bucket", "page")
    with common.shuffles_end_with_their_job(spark):
        dealt.write.partitionBy("bucket", "page").option("compression", "zstd").parquet(path)
    common.discard(loads)
    return path, pages


def classes(base: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of (doc_id, body, key): doc_id, keep_id, group_size, first (whether it stays), text_sha256."""
    spark = base.sparkSession
    path, pages = build_index(base, capacity)
    tasks = pages.repartition(max(1, min(pages.count(), 100_000)))
    found = common.settle(common.arrow_map(tasks, _own(path), CLASSES), "exact-classes")
    common.delete(spark, path)
    plain = found.filter("NOT overflow").select("doc_id", "keep_id", "group_size", "first", "text_sha256")
    # one text for each class of a page; grouping compares the bytes. A list holds the pages of one text
    shown = found.filter("overflow AND first").select("bucket", "page", "place", "keep_id", "group_size", "body")
    best = F.max(F.struct(F.col("keep_id").isNotNull().alias("some"), F.col("keep_id").alias("id"), (-F.col("page")).alias("page")))
    met = shown.groupBy("bucket", "body").agg(best.alias("best"), F.sum("group_size").alias("size"), F.collect_list(F.struct("page", "place")).alias("at"))
    met = met.select("bucket", F.inline("at"), F.col("best.id").alias("_id"), (-F.col("best.page")).alias("_page"), F.col("size").alias("_size"))
    rest = found.filter("overflow").drop("body").join(met, ["bucket", "page", "place"])
    rest = rest.select("doc_id", F.col("_id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("first") & (F.col("page") == F.col("_page"))).alias("first"), "text_sha256")
    return plain.unionByName(rest)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; the largest doc_id of equal texts stays."""
    return classes(hashed(docs), capacity).select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns. Documents are shuffled once, by id and text."""
    names = [f"_gl{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    kept = exact_dedup(docs, capacity).filter("kept").select(*common.id_keys(), F.col("text_sha256").alias("_gl_sha"))
    named = plain.select("*", *common.id_keys(id_), F.sha2(common.bytes_of(text), 256).alias("_gl_sha"))
    keys = ["_gl_id", "_gl_no_id", "_gl_sha"]
    return named.join(kept, keys, "left_semi").dropDuplicates(keys).select(*names).toDF(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.docs_of(spark, sf_dir))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
