"""Near copies by words: SimHash links and shared rare shingles, checked on the shingles themselves; none is missed.

Two texts are near copies if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more.
Such texts of sf0.1 differ in 8 to 9 of 64 fingerprint bits in the median, about the mean that the angle of
their sets gives (10, deviation 3); a radius that holds nearly all of them is so wide that bands no longer
tell texts apart. So texts meet in two ways, and the shingles decide:

1. Shingles: words as in simhash, XXH64 with seed 42; a shorter text is one shingle, as is an empty one.
2. Candidates within RADIUS bits: the tiled comparison of simhash, over fingerprints of 5-word shingles.
3. Candidates by first shingles. Under any one order of all shingles, two near copies share one of their first
   n - ceil(0.8 n) + 1. The order puts rare ones first, so that few texts have a first shingle in common: half of the
   shingles (by hash) come by the number of texts that have them, counted over all texts; then the other half by hash;
   then those that are common in a sample of documents, by how common. The half that is counted nearly always holds a
   text's first shingles. Shingles of one text only link nothing and go at once.
4. A first round: of those that have a first shingle, by size, each text meets the first and the one before it.
   These pairs and those of 2. are compared whole, on the shingles themselves; components of those that hold are
   the groups so far, which are nearly all.
5. A second round: all texts that have a first shingle in common and are of different groups meet, but for those
   whose sizes, places of the shingle, or parities of shingles by bucket show that they can't be near copies. These are
   compared whole too. Texts of one group do not meet again, so a large group costs no square of its size. A shingle's
   texts are dealt to blocks by hash, and a task gets two blocks, so that one which many texts have is many tasks' work.

So no near copy is missed: what one shingle doesn't link in the first round, the second does. Its pairs still grow
with the square of the texts of different groups that share a shingle rarer than a fifth of their own.

A text is known by its 64-bit hash, so equal texts are one node. Defined results: a null text counts as
empty; a null doc_id stays only if its group has no other; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common, simhash
from gridledger.llm.components import components

SHINGLE = 5
#: Similarity, as a fraction.
SIMILAR = (4, 5)
#: Bits between fingerprints of texts that need not share a first shingle.
RADIUS = 4
#: Orders of texts of one size.
ORDERS = 4
#: Texts of a block, where all that have a shingle in common are compared.
BLOCK = 256
#: Documents sampled for the order of shingles, and in how many a shingle is common.
SAMPLE = 5_000
COMMON = 10
#: The commonest shingles that the order knows; 16 bytes each are sent to the tasks.
KNOWN = 200_000
#: Shingles whose hash this divides are counted over all texts.
COUNTED = 2
#: Buckets of a text's shingles, of which parities are kept.
BUCKETS = 1024


def shingles(body: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text, sorted; the same words as simhash.fingerprint."""
    from xxhash import xxh64_intdigest

    words = body.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, simhash.SEED)], np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    view = memoryview(joined)
    return np.unique(np.fromiter((xxh64_intdigest(view[s:e], simhash.SEED) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n))


def first_shingles(n: int) -> int:
    """Of how many first shingles of a text of n a near copy shares one."""
    up, down = SIMILAR
    return n - -(-up * n // down) + 1


def ordered(found: np.ndarray, known: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that are counted, the others as the order has them); known (sorted) come as `often` as sampled."""
    times = np.zeros(len(found), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        times = np.where(known[at] == found, often[at], 0)
    counted = (times == 0) & (found % np.uint64(COUNTED) == 0)
    rest, times = found[~counted], times[~counted]
    return found[counted], rest[np.lexsort((rest, times))]


def parity(found: np.ndarray) -> bytes:
    """Whether the number of shingles of each bucket is odd: bits that differ between texts are at most the shingles that do."""
    return np.packbits(np.bincount((found % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1 == 1).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both, (up, down) = len(np.intersect1d(a, b, assume_unique=True)), SIMILAR
    return down * both >= up * (len(a) + len(b) - both)


def _each_shingle(batches):
    for batch in batches:
        for part in common.pieces_of(batch):
            for body in part.column(0).to_pylist():
                yield pa.record_batch([pa.array(shingles(body).view(np.int64))], names=["h"])


def _first_rows(known: np.ndarray, often: np.ndarray):
    """h, node, size, counted (how many of the text's shingles are), place: null for those that are counted, whose place
    is told when all are; of the others, come those that are among the first."""

    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                hashes, lens, rows = [], [], []
                for node, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = shingles(body)
                    counted, rest = ordered(found, known, often)
                    rest = rest[: max(0, first_shingles(len(found)) - len(counted))]
                    for own, places in ((counted, np.full(len(counted), -1)), (rest, len(counted) + np.arange(len(rest)))):
                        hashes.append(own)
                        lens.append(places)
                    rows.append((node, len(found), len(counted), len(counted) + len(rest)))
                if rows:
                    node, size, counted, n = (np.array(x, np.int64) for x in zip(*rows))
                    place = np.concatenate(lens).astype(np.int32)
                    arrays = [np.concatenate(hashes).view(np.int64), np.repeat(node, n), np.repeat(size, n).astype(np.int32), np.repeat(counted, n).astype(np.int32)]
                    yield pa.record_batch([*[pa.array(x) for x in arrays], pa.array(place, mask=place < 0)], names=["h", "node", "size", "counted", "place"])

    return run


def first_rows(texts: DataFrame) -> DataFrame:
    """h, node, size, place: the first shingles of each text that other texts have too, and their places in the order."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    up, down = SIMILAR
    every = common.arrow_map(texts, _first_rows(*common_shingles(texts)), "h long, node long, size int, counted int, place int")
    # shingles that aren't counted are dealt by text as well, as a common one may be in any number of texts
    own = F.when(F.col("place").isNotNull(), F.col("node")).otherwise(F.lit(0))
    told = every.withColumn("_own", own).withColumn("_n", F.count("*").over(Window.partitionBy("h", "_own")))
    told = told.filter(F.col("place").isNotNull() | (F.col("_n") > 1)).drop("_own").repartition(n, "node").dropDuplicates(["node", "h"])
    of = Window.partitionBy("node", F.col("place").isNull())
    # those of no other text come first
    place = F.col("counted") - F.count("*").over(of) + F.row_number().over(of.orderBy("_n", "h")) - 1
    told = told.withColumn("place", F.coalesce("place", place.cast("int")))
    return told.filter(F.col("place") < F.expr(f"size - ({up} * size + {down - 1}) div {down} + 1")).select("h", "node", "size", "place")


def _shared(batches):
    """Rows come sorted by h: for each after the first of its h, pairs with the first node and with the one before."""
    last = None  # (h, first node and its size, last node and its size) so far
    for batch in batches:
        if not batch.num_rows:
            continue
        h, node, size = (batch.column(k).to_numpy() for k in range(3))
        if last is not None:
            h, node, size = np.concatenate([last[0], h]), np.concatenate([last[1], node]), np.concatenate([last[2], size])
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        before = np.arange(len(h)) - 1
        fresh = np.arange(len(h)) >= (2 if last is not None else 0)  # the rows held from before have had their pairs
        pairs = [(c, np.nonzero(fresh & ~new & (node[c] != node))[0]) for c in (start, np.where(new, start, before))]
        ends = [np.concatenate([x[c[at]] for c, at in pairs] + [x[at] for _, at in pairs]).reshape(2, -1) for x in (node, size)]
        if ends[0].shape[1]:
            low, high = ends[0].min(axis=0), ends[0].max(axis=0)
            yield pa.record_batch([pa.array(low), pa.array(high), pa.array(ends[1].min(axis=0).astype(np.int32)), pa.array(ends[1].max(axis=0).astype(np.int32))], names=["a", "b", "least", "most"])
        held = [int(start[-1]), len(h) - 1]
        last = (h[held], node[held], size[held])


def all_shared(first: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, least, most: all pairs of texts that have a first shingle in common; first: h, node, size. With place, parity
    and root: those of different roots that may be near copies."""
    n = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rooted = "root" in first.columns
    carried = ["node", "size", *(["place", "parity", "root"] if rooted else [])]
    counts = first.groupBy("h").agg(F.ceil(F.count("*") / block).alias("_blocks"), F.count("*").alias("_n"), *([F.min("root").alias("_low"), F.max("root").alias("_high")] if rooted else []))
    counts = counts.filter("_low < _high" if rooted else "_n > 1").select("h", "_blocks")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    each = first.join(counts, "h").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    each = each.select("h", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", *carried)
    dealt = each.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j")
    return common.arrow_map(dealt, _all_pairs, "a long, b long, least int, most int")


def _all_pairs(batches):
    from itertools import groupby

    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    for (_, i, j), group in groupby(rows, lambda r: r[:3]):
        own, node, size, *more = list(zip(*group))[3:]
        own, node, size = np.array(own), np.array(node), np.array(size, np.int64)
        # of two blocks, one side each; within one block every pair once
        x, y = np.nonzero((node[:, None] < node) if i == j else (own == i)[:, None] & (own == j))
        if more:
            x, y = _possible(x, y, size, *more)
        if len(x):
            ends = [np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]
            sizes = [np.minimum(size[x], size[y]).astype(np.int32), np.maximum(size[x], size[y]).astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in ends + sizes], names=["a", "b", "least", "most"])


def _possible(x, y, size, place, parities, root):
    """Of pairs (x, y) of one shingle, those of different roots that may be near copies. They share the shingle, at most
    as many before it as the lesser place, and after it as the lesser rest; and they differ in no fewer shingles than
    parities."""
    (up, down), place, root = SIMILAR, np.array(place, np.int64), np.array(root)
    marks = np.frombuffer(b"".join(parities), np.uint64).reshape(len(size), -1)
    rest, both = size - place - 1, size[x] + size[y]
    most = np.minimum(place[x], place[y]) + 1 + np.minimum(rest[x], rest[y])
    keep = (root[x] != root[y]) & (most * (up + down) >= up * both)
    x, y, both = x[keep], y[keep], both[keep]
    keep = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64) * (up + down) <= (down - up) * both
    return x[keep], y[keep]


def _sets(batches):
    for batch in batches:
        for part in common.pieces_of(batch):
            found = [shingles(body) for body in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([parity(f) for f in found], pa.binary())], names=["node", "grams", "parity"])


def _compared(batches):
    for batch in batches:
        of = lambda k: (np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist())
        holds = [alike(x, y) for x, y in zip(of(2), of(3))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(holds, pa.bool_())], names=["a", "b", "holds"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with holds: whether their texts are near copies."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    other = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    rows = pairs.join(other, "b").join(one, "a").select("a", "b", "grams_a", "grams_b")
    return common.settle(common.arrow_map(rows, _compared, "a long, b long, holds boolean"), "near-compared")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, sorted, and in how many sampled texts they are; at most KNOWN."""
    every = max(1, texts.count() // SAMPLE)
    sample = common.arrow_map(texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("body"), _each_shingle, "h long")
    rows = sample.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(KNOWN).toPandas()
    known, often = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], often[order]


def near_components(docs: DataFrame, exact: bool = True) -> DataFrame:
    """node, root for the texts (by hash) that have near copies; not exact: by the first round only, which misses a few."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(node_of().alias("node"), common.bytes_of().alias("body"))
    prints = common.settle(simhash.fingerprints(docs.select(node_of().alias("doc_id"), "text"), SHINGLE).distinct(), "near-prints")
    heads = common.settle(prints.groupBy("bits").agg(F.min("doc_id").alias("head")), "near-heads")
    linked = simhash.links(heads.select("bits"), RADIUS)
    to_a, to_b = heads.select(F.col("bits").alias("a"), F.col("head").alias("_a")), heads.select(F.col("bits").alias("b"), F.col("head").alias("_b"))
    linked = linked.join(to_a, "a").join(to_b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    same = prints.join(heads, "bits").filter("head < doc_id").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))

    first = common.settle(first_rows(texts), "near-first")
    up, down = SIMILAR
    dealt = first.select("h", "node", "size").repartition(n, "h").sortWithinPartitions("h", "size", F.xxhash64("node", F.pmod("h", F.lit(ORDERS))))
    met = common.arrow_map(dealt, _shared, "a long, b long, least int, most int").filter(F.col("least") * down >= F.col("most") * up)
    pairs = common.settle(linked.union(same).union(met.select("a", "b")).distinct(), "near-pairs")
    # the texts that meet others, once: sets are made for no others
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(first.select("node")).distinct()
    sets = common.settle(common.arrow_map(texts.join(ends, "node", "left_semi"), _sets, "node long, grams binary, parity binary").dropDuplicates(["node"]), "near-sets")
    tried = compared(pairs, sets)
    holds = tried.filter("holds").select("a", "b")
    roots = components(holds)
    if exact:
        named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets.select("node", "parity"), "node")
        others = all_shared(named).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        late = compared(others, sets).filter("holds").select("a", "b")
        if not late.isEmpty():
            roots = components(holds.union(late))
    common.discard(prints, heads, first, pairs, sets)
    return roots


def node_of():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_near_copies(docs: DataFrame, exact: bool = True) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id (and text hash); exact: as in near_components."""
    names = [f"_gl{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    node = F.xxhash64(F.coalesce(text, F.lit(""))).alias("_gl_node")
    rows = plain.select(*common.id_keys(id_), node).withColumn("_at", F.struct("_gl_no_id", "_gl_id", "_gl_node"))
    roots = near_components(docs, exact)
    named = rows.join(roots, F.col("_gl_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_gl_node"))
    stay = named.groupBy("_root").agg(F.min("_at").alias("_at")).select("_at.*")
    on = ["_gl_id", "_gl_no_id", "_gl_node"]
    return plain.select("*", *common.id_keys(id_), node).join(stay, on, "left_semi").dropDuplicates(on).select(*names).toDF(*docs.columns)
