"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

1. Fingerprints: A-Z to lower case, words by ASCII white space, shingles of `shingle` words with repeats
   (a shorter text is one shingle; no word: fingerprint zero), XXH64 with seed 42, a bit is 1 if set in
   over half of the hashes. Long texts are counted in slices.
2. Only different fingerprints are compared, so copies cost nothing. Two within `radius` bits agree on
   at least `agree` of radius + agree bands of bits, so a tile holds the fingerprints that are equal on
   one choice of `agree` bands. More bands agree where there are more fingerprints, which keeps tiles
   small at any size; no choice loses a link. A tile of over `tile_rows` is cut by population count (and
   hash); pairs of its tiles whose counts differ by more than the radius are skipped, the others are
   compared by any task.
3. In a tile, numpy compares blocks by exclusive-or and bit counts, again only within the radius of the
   population counts, and hands on a spanning forest of the links found: never all pairs of a group.
4. Components of the forest give each document the smallest doc_id that it reaches.

Defined results: a null or empty text has fingerprint zero and is linked like any other; rows that
repeat a doc_id share its fingerprint group by text; a null doc_id never is a component's id unless all
are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common
from gridledger.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 4096
#: Shingles hashed at a time.
SLICE = 1 << 15


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = body.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    view, ones = memoryview(joined), np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        hashes = np.fromiter((xxh64_intdigest(view[s:e], SEED) for s, e in zip(starts[at : at + SLICE], ends[at : at + SLICE])), np.uint64, min(SLICE, n - at))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                seen: dict[bytes, int] = {}
                found = []
                for body in part.column(1).to_pylist():
                    if body not in seen:
                        seen[body] = fingerprint(body, shingle)
                    found.append(seen[body])
                yield pa.record_batch([part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and bits (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.bytes_of().alias("body"))
    return common.arrow_map(rows, _fingerprints(shingle), "doc_id long, bits long")


def masks_of(radius: int = RADIUS, agree: int = 1) -> list[int]:
    """The bits of each choice of `agree` out of radius + agree bands, as signed longs."""
    n = radius + agree
    edges = [64 * k // n for k in range(n + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(bands, agree)]


def agreeing(n: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> int:
    """The fewest agreeing bands by which random fingerprints fill tiles to a fourth on average."""
    return next((a for a in (1, 2, 3) if n >> (64 * a // (radius + a)) <= tile_rows // 4), 4)


def forest(bits: np.ndarray, sides: np.ndarray, across: bool, radius: int = RADIUS, block: int = 256) -> list[tuple[int, int]]:
    """Edges (places in bits) of a spanning forest of the links; across: only between sides 0 and 1."""
    counts = np.bitwise_count(bits)
    order = np.argsort(counts, kind="stable")
    bits, counts, sides = bits[order], counts[order].astype(np.int16), sides[order]
    label, edges = np.arange(len(bits)), []
    for at in range(0, len(bits), block):
        to = int(np.searchsorted(counts, counts[min(at + block, len(bits)) - 1] + radius, "right"))
        near = np.bitwise_count(bits[at : at + block, None] ^ bits[None, at:to]) <= radius
        if across:
            near &= sides[at : at + block, None] != sides[None, at:to]
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        while True:
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                break
            # one link for each label that can be hung under a smaller one
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            high, first = np.unique(high, return_index=True)
            edges += zip(order[i[first]].tolist(), order[j[first]].tolist())
            up = np.arange(len(bits))
            up[high] = low[first]
            while (up[up] != up).any():
                up = up[up]
            label = up[label]
    return edges


def _links(radius: int):
    def of(bits: list[int], sides: list[int], across: bool):
        if len(bits) > 1:
            arr = np.array(bits, np.int64)
            for a, b in forest(arr.view(np.uint64), np.array(sides, np.int8), across, radius):
                yield int(arr[a]), int(arr[b])

    def run(batches):
        """Rows come sorted by tile; a tile (or pair of tiles) has at most twice TILE_ROWS rows."""
        key, bits, sides, out = None, [], [], []
        for batch in batches:
            for k, b, s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if (k, x) != key:
                    if key is not None:
                        out += of(bits, sides, key[1])
                    key, bits, sides = (k, x), [], []
                bits.append(b)
                sides.append(s)
            if len(out) > 10_000:
                yield pa.record_batch([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
                out = []
        if key is not None:
            out += of(bits, sides, key[1])
        if out:
            yield pa.record_batch([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def tiles(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, agree: int = 1) -> DataFrame:
    """(tile, bits, side, across): the rows of tiles and of pairs of tiles to compare."""
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks_of(radius, agree))])
    rows = prints.select("bits", F.bit_count("bits").cast("int").alias("pop"), F.explode(bands).alias("b")).select("bits", "pop", "b.band", "b.value")
    sums = rows.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    large = sums.groupBy("band", "value").agg(F.sum("n").alias("all")).filter(F.col("all") > tile_rows).select("band", "value")
    sums = sums.join(large, ["band", "value"], "left_semi").withColumn("cuts", F.ceil(F.col("n") / F.lit(tile_rows)).cast("int"))
    plain = rows.join(large, ["band", "value"], "left_anti").select(F.xxhash64("band", "value").alias("tile"), "bits", F.lit(0).alias("side"), F.lit(False).alias("across"))
    # tiles of large bands: population count and a cut of it by hash
    cut = sums.select("band", "value", "pop", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = cut.select("band", "value", F.col("pop").alias("pop2"), F.col("cut").alias("cut2"))
    # each cut meets only population counts that the radius allows
    reach = cut.withColumn("pop2", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    pairs = reach.join(other, ["band", "value", "pop2"]).filter((F.col("pop") < F.col("pop2")) | (F.col("cut") <= F.col("cut2")))
    pairs = pairs.withColumn("tile", F.xxhash64("band", "value", "pop", "cut", "pop2", "cut2")).withColumn("across", (F.col("pop") != F.col("pop2")) | (F.col("cut") != F.col("cut2")))
    sides = pairs.select("band", "value", "pop", "cut", "tile", "across", F.lit(0).alias("side")).union(
        pairs.filter("across").select("band", "value", F.col("pop2").alias("pop"), F.col("cut2").alias("cut"), "tile", "across", F.lit(1).alias("side")))
    big = rows.join(sums.select("band", "value", "pop", "cuts"), ["band", "value", "pop"]).withColumn("cut", F.pmod(F.xxhash64("bits"), F.col("cuts")).cast("int"))
    # a cut has few tiles beside a fifth of its band's, so this grows with the square of one band's cuts at most
    paired = big.join(sides, ["band", "value", "pop", "cut"]).select("tile", "bits", "side", "across")
    return plain.union(paired)


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, agree: int | None = None) -> DataFrame:
    """Edges (a, b) between different fingerprints: in each tile a spanning forest of its links."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    agree = agree or agreeing(prints.count(), radius, tile_rows)
    dealt = tiles(prints, radius, tile_rows, agree).repartition(n, "tile").sortWithinPartitions("tile", "across")
    return common.arrow_map(dealt, _links(radius), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    rows = common.settle(fingerprints(docs, shingle), "prints")
    prints = common.settle(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "print-groups")
    roots = components(links(prints, radius, tile_rows))
    named = prints.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "root").select("bits", "component_id")
    return rows.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.docs_of(spark, sf_dir))
