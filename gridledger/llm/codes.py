"""Vector code compression: product codes by Lloyd rounds whose members stay where their entry is owned.

Vectors are cut into `parts` equal parts (by floor(i*d/parts) where the length is no multiple of it). A part of a
vector is a member of the codebook entry that is nearest to it. Members live in an RDD that is partitioned by
(position, entry, salt): for each position and entry every partition owns one salt, so an entry with all vectors
is spread as evenly as any other. In a round

* owners sum their resident members; only the sums (positions x entries numbers) reach the driver, which floors
  them into new entries,
* owners assign their members anew; those that stay are not moved (the union below keeps the partitioning, so
  Spark plans no exchange for them), and only those that change entry are shuffled to their new owner.

Members are kept by Spark in memory or on the executors' disks for one round; all is deterministic, so what a
lost executor held is computed again from the rounds before, down to the settled table of integer vectors.

Defined results: vectors that are null or empty, or hold null or non-finite components, or components too large
for their squared distances to be longs (from 2^18/sqrt(d) on), are left out, as are those of another length than
the commonest; fewer vectors than entries give smaller codebooks; null vec_ids come last in the order of the first
entries, ties are broken by the vectors; repeated rows each get a row; null labels are one label; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Members of one partition.
RESIDENTS = 1 << 19
#: Members whose distances are held at once.
CHUNK = 1 << 13


def cuts(d: int, parts: int) -> list[slice]:
    return [slice(i * d // parts, (i + 1) * d // parts) for i in range(parts)]


def integers(table: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(row, vec_id, label, x: components as integers) of the vectors that count, settled; and their length."""
    rows = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(vectors.sound(float(1 << 18), "v"))
    rows, d = vectors.of_one_length(rows, "v")
    rows = rows.filter(vectors.sound((1 << 18) / max(d, 1) ** 0.5, "v"))
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long"))
    return common.settle(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", x.alias("x")), "code-vectors"), d


def assigned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row; ties go to the lower entry.

    Where every term is a whole number below 2^53, doubles hold it exactly, and a matrix product does the work."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(float), book.astype(float)
        d = ((a * a).sum(1)[:, None] + (b * b).sum(1)[None]) - 2 * (a @ b.T)
        entry = d.argmin(1)
        return entry, np.take_along_axis(d, entry[:, None], 1)[:, 0].astype(np.int64)
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        d = ((x[at : at + CHUNK, None, :] - book[None]) ** 2).sum(2)
        entry[at : at + CHUNK] = near = d.argmin(1)
        error[at : at + CHUNK] = np.take_along_axis(d, near[:, None], 1)[:, 0]
    return entry, error


def _owner(key: tuple) -> int:
    """Of (position, entry, salt); the salts of an entry go round all partitions."""
    return key[0] * 31 + key[1] + key[2]


def _by_entry(pos, salt, entry, rows, x):
    """((position, entry, salt), (rows, members)) of members of one position and salt."""
    if (entry == entry[0]).all():  # most often in later rounds
        yield (pos, int(entry[0]), salt), (rows, x)
        return
    order = np.argsort(entry, kind="stable")
    found, starts = np.unique(entry[order], return_index=True)
    for e, part in zip(found.tolist(), np.split(order, starts[1:])):
        yield (pos, e, salt), (rows[part], x[part])


def _placing(books, places, salts):
    """Batches of vectors to blocks of members at their first entry, by owner."""

    def run(batches):
        for batch in batches:
            rows, x = batch.column(0).to_numpy(), vectors.matrix(batch.column(1))
            salt = (rows + (rows >> 33)) % salts
            blocks = []
            for s in np.unique(salt):
                own = salt == s
                for pos, place in enumerate(places):
                    part = x[own][:, place]
                    blocks += [(*key, r.tobytes(), m.tobytes()) for key, (r, m) in _by_entry(pos, int(s), assigned(part, books[pos])[0], rows[own], part)]
            if blocks:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["pos", "entry", "salt", "rows", "members"])

    return run


def _reading(widths):
    def read(r):
        rows = np.frombuffer(r.rows, np.int64)
        return (r.pos, r.entry, r.salt), (rows, np.frombuffer(r.members, np.int64).reshape(len(rows), widths[r.pos]))

    return read


def _gathered(blocks):
    """{key: (rows, members)} of a partition's blocks."""
    held = {}
    for key, block in blocks:
        held.setdefault(key, []).append(block)
    return {k: (np.concatenate([r for r, _ in v]), np.concatenate([m for _, m in v])) for k, v in held.items()}


def _sums(blocks):
    """((position, entry), (count, sums)) of a partition's members."""
    out = {}
    for (pos, entry, _), (_, m) in blocks:
        own = np.concatenate([[len(m)], m.sum(0)]).astype(object)
        out[pos, entry] = out[pos, entry] + own if (pos, entry) in out else own
    return iter(out.items())


def _judging(books):
    """A partition's members assigned anew: ((position, entry, salt), (rows, members, whether they come from elsewhere))."""

    def run(blocks):
        for (pos, entry, salt), (rows, m) in _gathered(blocks).items():
            for key, block in _by_entry(pos, salt, assigned(m, books[pos])[0], rows, m):
                yield key, (*block, key[1] != entry)

    return run




def settled_members(members, books: list[np.ndarray], rounds: int, partitions: int):
    """(members after the last assignment, books): `rounds` times entries move to their members' mean, then members to the nearest entry."""
    before = None
    for _ in range(rounds):
        means = members.mapPartitions(_sums).reduceByKey(add, partitions).collect()  # a row for each entry
        books = [b.copy() for b in books]
        for (pos, entry), total in means:
            books[pos][entry] = [v // total[0] for v in total[1:]]
        judged = members.mapPartitions(_judging(books), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        stay = judged.filter(lambda kv: not kv[1][2]).mapValues(lambda v: v[:2])
        move = judged.filter(lambda kv: kv[1][2]).mapValues(lambda v: v[:2]).partitionBy(partitions, _owner)
        members = stay.union(move)
        judged.count()  # held before what it was made of is let go
        if before is not None:
            before.unpersist()
        before = judged
    return members, books, before


def _told(books):
    """Blocks of members to (pos, entry, rows, errors), arrays as bytes."""

    def run(blocks):
        for (pos, entry, _), (rows, m) in blocks:
            yield pos, entry, rows.tobytes(), ((m - books[pos][entry]) ** 2).sum(1).tobytes()

    return run


def _rows_of(batches):
    for batch in batches:
        pos, entry, rows, errors = [c.to_pylist() for c in batch.columns]
        rows, errors = [np.frombuffer(x, np.int64) for x in rows], [np.frombuffer(x, np.int64) for x in errors]
        n = [len(x) for x in rows]
        if sum(n):
            yield pa.record_batch([pa.array(np.concatenate(rows)), pa.array(np.repeat(np.array(pos, np.int32), n)), pa.array(np.repeat(np.array(entry, np.int32), n)), pa.array(np.concatenate(errors))], names=["row", "pos", "entry", "error"])


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for entry in b for v in entry).encode()).hexdigest()


def label_sums(rows: DataFrame) -> DataFrame:
    """rows with label_error: error summed over equal labels. Labels of over a thousandth of the rows, at most a
    thousand, are sent to all tasks; those of fewer rows meet their sums by a join."""
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    total = rows.count()
    hot, cold = sums.filter(F.col("_n") * 1000 > total), sums.filter(F.col("_n") * 1000 <= total)
    same, hot = F.col("label").eqNullSafe(F.col("_label")), F.broadcast(hot)
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(cold, same)).drop("_label", "_n")


def encoded(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error of every vector that counts; the codebooks by part)."""
    spark = table.sparkSession
    common.ship(spark)
    rows, d = integers(table, scale)
    first = [r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    places = cuts(d, parts)
    books = [np.array([x[p] for x in first], np.int64).reshape(len(first), p.stop - p.start) for p in places]
    codes = rows.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    held = None
    if first:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * parts // RESIDENTS))
        blocks = rows.select("row", "x").mapInArrow(_placing(books, places, partitions), "pos int, entry int, salt int, rows binary, members binary")
        members = blocks.rdd.map(_reading([p.stop - p.start for p in places])).partitionBy(partitions, _owner)
        members, books, held = settled_members(members, books, rounds, partitions)
        told = spark.createDataFrame(members.mapPartitions(_told(books)), "pos int, entry int, rows binary, errors binary")
        each = told.mapInArrow(_rows_of, "row long, pos int, entry int, error long")
        digits = F.lower(F.lpad(F.hex("entry"), 2, "0"))
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", digits.alias("digits")))), lambda p: p["digits"])  # parts of one vector
        codes = each.groupBy("row").agg(F.array_join(in_order, "").alias("code"), F.sum("error").alias("error"))
    out = common.settle(rows.join(codes, "row").select("vec_id", "label", "code", "error"), "codes")
    if held is not None:
        held.unpersist()
    common.discard(rows)
    return label_sums(out), books


def sql(dims: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the rows of op13_codes, a pair of tables for each round."""
    width = dims // parts
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c AS MATERIALIZED (SELECT r, i // {width} AS pos, i % {width} AS k, x[i + 1] AS val FROM v, range({dims}) t(i)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {entries}), b0 AS MATERIALIZED (SELECT pos, entry, k, val FROM c JOIN f USING (r))"""
    for n in range(rounds + 1):
        out += f""",
d{n} AS (SELECT r, c.pos, entry, CAST(sum((c.val - b.val) * (c.val - b.val)) AS BIGINT) AS dist FROM c JOIN b{n} b ON b.pos = c.pos AND b.k = c.k GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT r, pos, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM d{n} GROUP BY r, pos)"""
        if n < rounds:
            out += f""",
m{n} AS (SELECT pos, entry, k, CAST(floor(sum(val) / count(*)) AS BIGINT) AS val FROM a{n} JOIN c USING (r, pos) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT pos, entry, k, coalesce(m.val, b.val) AS val FROM b{n} b LEFT JOIN m{n} m USING (pos, entry, k))"""
    return out + f""",
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(val, ',' ORDER BY pos, entry, k)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN e USING (r)"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
