"""Suffix-array dedup: passages of `window` bytes or more that occur more than once.

How equal windows meet. The smallest hash of the `gram`-byte strings in a window (leftmost on ties) is
the window's anchor. Equal windows have equal anchors at equal offsets, so the windows that could match
are found by anchor hash: about one anchor in 85 bytes. An anchor that occurs once in the corpus rules
out all its windows. For the others, the bytes that their windows span (a segment, at most twice the
window) are cut from the text; equal segments of one anchor are kept once, with their number.

Which windows match. Tasks take whole anchor groups and build an enhanced suffix array (suffix array by
doubling, and longest common prefixes) over their segments. A stack scan walks the common-prefix
intervals of at least `window` bytes; an interval whose suffixes have different bytes on their left is
a maximal repeat, and all its occurrences are marked. Intervals without that diversity are shifts of
longer ones. Segments end where their anchor's windows end, so repeats are maximal among the segments;
a longer passage comes as overlapping repeats of neighbouring anchors, and their union is exact.
An anchor with more than `hot_segments` different segments (at the edge of a passage that a third of all
texts hold) is too much for a task. Its segments are cut finer: the windows with nearly the same offset to
the anchor have most of their bytes in common, and these bytes are part of the finer group's name. Groups
that are still too large are cut once more, down to one offset, where a group is one window. So every
window is in a suffix array with all windows that equal it, and a span found in a finer segment is carried
back to the segments that it was cut from.

An anchor with over 1 / HOT_PLACES of all places is kept by a list of such anchors (fewer than HOT_PLACES)
that all tasks have; the others meet their repeats in a shuffle, so no task gets a large share.

Texts are kept once, bucketed by the hash that the later joins use, so they are shuffled once; they are
told apart by 128 bits of their SHA-256. Copies of a whole text are counted beforehand.

Defined results: null counts as empty; texts shorter than the window lose nothing and match nothing;
rows that repeat a doc_id and text are occurrences of their own; overlaps within one text count; an
empty table gives no rows; other columns are not read. A window is longer than the gram and at most
LONGEST_WINDOW bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common

WINDOW = 200
GRAM = 32
#: Different segments of one anchor that a task takes.
HOT_SEGMENTS = 8000
#: Offsets that share a finer group, level by level; the last level is one window.
FINER = (12, 1)
#: An anchor with more than this part of all places is frequent.
HOT_PLACES = 2000
#: Up to so many hot anchors are sent to all tasks; more are joined.
SENT_ANCHORS = 1_000_000
#: Offsets are kept in 16 bits.
LONGEST_WINDOW = 1 << 15
#: Bytes of segments in one suffix array, unless one anchor has more.
ARRAY_BYTES = 1 << 20
#: Window starts looked at together; positions within fit in 24 bits.
SLICE = 1 << 22
BASE = 0x2545F4914F6CDD1D


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    size = 1 << max(16, int(len(b)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(body: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first and last window start) of the anchors of a text's windows."""
    found, low = [], np.uint64((1 << 24) - 1)
    for at in range(0, len(body) - window + 1, SLICE):
        last = min(at + SLICE, len(body) - window + 1)
        b = np.frombuffer(body, np.uint8)[at : last - 1 + window]
        h = gram_hashes(b, gram)
        place = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & low).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
        end = np.concatenate([first[1:], [len(place)]]) - 1
        found.append((h[place[first]].view(np.int64), place[first] + at, first + at, end + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found))


class SuffixArray:
    """Suffix array and common prefixes of segments; suffixes end with their segment.

    Only suffixes of at least `least` bytes are listed."""

    #: Symbols (byte + 1, or 0 for the end) of 9 bits that one number holds.
    PACK = 7

    def __init__(self, segments: list[bytes], least: int):
        sizes = np.array([len(s) for s in segments], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        sym = np.zeros(int(ends[-1]) + 1, np.uint64)
        text = np.ones(len(sym), bool)
        text[ends] = False
        sym[text] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64) + np.uint64(1)
        self.starts, self.sym, self.n = ends - sizes, sym, len(sym)
        self.segment = np.repeat(np.arange(len(segments)), sizes + 1)
        self.rest = ends[self.segment] - np.arange(self.n)
        self.levels: list[tuple[int, np.ndarray]] = []
        self._double(int(sizes.max()))
        listed = np.nonzero(self.rest >= least)[0]
        self.order = listed[np.argsort(self._pairs(listed), kind="stable")]
        self.prefix = self._prefixes(self.order[:-1], self.order[1:])

    def _double(self, longest: int) -> None:
        key = np.zeros(self.n, np.uint64)
        for k in range(self.PACK):
            moved = np.zeros(self.n, np.uint64)
            moved[: self.n - k] = self.sym[k:]
            key = (key << np.uint64(9)) | np.where(self.rest > k, moved, np.uint64(0))
        self.levels.append((self.PACK, self._ranks(key)))
        every = np.arange(self.n)
        while 2 * self.levels[-1][0] < longest:
            self.levels.append((2 * self.levels[-1][0], self._ranks(self._pairs(every))))

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        """The last level's rank at each place and at its end: the order of twice the depth."""
        depth, rank = self.levels[-1]
        on = self.rest[at] >= depth
        return (rank[at] << 32) | np.where(on, rank[np.where(on, at + depth, 0)], 0)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        held = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], held[1:] != held[:-1]]))
        return rank

    def _prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b."""
        most = np.minimum(self.rest[a], self.rest[b])
        done = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            on = done < most
            i, j = np.where(on, a + done, 0), np.where(on, b + done, 0)
            done += np.where(on & (rank[i] == rank[j]), depth, 0)
        for _ in range(self.PACK):
            on = done < most
            i, j = np.where(on, a + done, 0), np.where(on, b + done, 0)
            done += on & (self.sym[i] == self.sym[j])
        return np.minimum(done, most)

    def maximal_repeats(self, least: int):
        """(length, suffixes) of each common-prefix interval of `least` or more with different left bytes."""
        left = np.where(self.order > self.starts[self.segment[self.order]], self.sym[self.order - 1].astype(np.int64), -1).tolist()
        long = self.prefix >= least
        edges = np.nonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))[0]
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            prefix = [*self.prefix[begin:end].tolist(), 0]
            stack: list[list[int]] = []  # [length, first suffix, left byte or -2 if there are several]
            for k, p in enumerate(prefix):
                at = begin + k
                first, byte = at, left[at] if left[at] >= 0 else -2
                while stack and stack[-1][0] > p:
                    length, first, seen = stack.pop()
                    byte = seen if seen == byte else -2
                    if byte == -2:
                        yield length, self.order[first : at + 1]
                if stack and stack[-1][0] == p:
                    if stack[-1][2] != byte:
                        stack[-1][2] = -2
                elif p >= least:
                    stack.append([p, first, byte])


def covered(segments: list[bytes], counts: list[int], least: int = WINDOW) -> list[tuple[int, int, int]]:
    """(segment, from, to) of the bytes within repeats; counts: how often each (different) segment occurs."""
    array = SuffixArray(segments, least)
    depth = np.zeros(array.n + 1, np.int64)
    for length, suffixes in array.maximal_repeats(least):
        np.add.at(depth, suffixes, 1)
        np.add.at(depth, suffixes + length, -1)
    often = np.array(counts) > 1
    np.add.at(depth, array.starts[often], 1)
    np.add.at(depth, array.starts[often] + np.array([len(s) for s in segments])[often], -1)
    inside = np.cumsum(depth[:-1]) > 0
    edges = np.nonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))[0]
    return [(int(array.segment[a]), int(a - array.starts[array.segment[a]]), int(b - array.starts[array.segment[a]])) for a, b in zip(edges[::2], edges[1::2])]


def _once(batches):
    """Each different text of a task once, with its keys."""
    seen = set()
    for batch in batches:
        for part in common.pieces_of(batch):
            keys, bodies = [], []
            for body in part.column(0).to_pylist():
                digest = hashlib.sha256(body).digest()[:16]
                if digest not in seen:
                    seen.add(digest)
                    keys.append(digest)
                    bodies.append(body)
            if keys:
                pair = [pa.array([int.from_bytes(k[i : i + 8], "big", signed=True) for k in keys], pa.int64()) for i in (0, 8)]
                yield pa.record_batch([*pair, pa.array(bodies, pa.binary())], names=["tid", "tid2", "body"])


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                got = [(tid, *anchors(body, window, gram)) for tid, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                if got:
                    h, place, first, last = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3, 4))
                    tid = np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1]) for g in got])
                    # place, and how far before it the first and last windows start
                    packed = (place << 32) | ((place - first) << 16) | (place - last)
                    yield pa.record_batch([pa.array(h), pa.array(tid), pa.array(packed)], names=["anchor", "tid", "place"])

    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                rows: list[tuple] = []
                for tid, tid2, body, hits in zip(*[part.column(k).to_pylist() for k in range(4)]):
                    for hit in hits:
                        place = hit["place"]
                        place, first, last = place >> 32, (place >> 32) - (place >> 16 & 0xFFFF), (place >> 32) - (place & 0xFFFF)
                        if last + window <= len(body):  # else it is of another text with this tid
                            rows.append((hit["anchor"], tid, tid2, first, place - first, body[first : last + window]))
                    if len(rows) > 20_000:
                        yield _segment_batch(rows)
                        rows = []
                if rows:
                    yield _segment_batch(rows)

    return run


def _segment_batch(rows):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["anchor", "tid", "tid2", "first", "at", "segment"])


def finer(anchor: int, at: int, segment: bytes, width: int, window: int, gram: int):
    """(begin, group, place of the anchor, bytes) of the parts of a segment whose windows' offsets to the anchor are in
    one class of `width` offsets. Bytes that all windows of a class share are in the group's name."""
    from xxhash import xxh64_intdigest

    for kind in range((at - len(segment) + window) // width, at // width + 1):
        near, far = kind * width, min((kind + 1) * width - 1, window - gram)
        begin, end = at - min(at, far), at - max(at - len(segment) + window, near) + window
        shared = segment[at - near : at - far + window]
        name = xxh64_intdigest(struct.pack("<qq", anchor, kind) + shared)
        yield begin, name - (1 << 64 if name >> 63 else 0), at - begin, segment[begin:end]


FINER_ROWS = "up1 long, up2 long, delta long, anchor long, at long, segment binary, n long"


def _refine(width: int, window: int, gram: int):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ["up1", "up2", "delta", "anchor", "at", "segment", "n"]

    def run(batches):
        for batch in batches:
            for part in common.pieces_of(batch):
                rows = []
                for anchor, key1, key2, at, segment, n in zip(*[part.column(k).to_pylist() for k in range(6)]):
                    rows += [(key1, key2, begin, group, place, piece, n) for begin, group, place, piece in finer(anchor, at, segment, width, window, gram)]
                if rows:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _scan(window: int):
    """Rows come sorted by anchor; one suffix array takes whole anchors.

    A window has one offset to its anchor, so a segment repeats nothing within itself: an anchor with one
    segment is a single leaf, which is a repeat if the segment occurs several times."""

    def of(rows, leaves):
        found = covered([r[2] for r in rows], [r[3] for r in rows], window) if rows else []
        keys = [(rows[s][0], rows[s][1], a, b) for s, a, b in found] + [(r[0], r[1], 0, len(r[2])) for r in leaves if r[3] > 1]
        return pa.record_batch([pa.array([k[i] for k in keys], pa.int64()) for i in range(4)], names=["key1", "key2", "begin", "end"])

    def run(batches):
        rows, leaves, group, size, now = [], [], [], 0, None
        for batch in batches:
            for anchor, key1, key2, segment, n in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if anchor != now:
                    (rows if len(group) > 1 else leaves).extend(group)
                    group, now = [], anchor
                    if size > ARRAY_BYTES:
                        yield of(rows, leaves)
                        rows, leaves, size = [], [], 0
                group.append((key1, key2, segment, n))
                size += len(segment)
        (rows if len(group) > 1 else leaves).extend(group)
        yield of(rows, leaves)

    return run


def _remove(batches):
    for batch in batches:
        for part in common.pieces_of(batch):
            out = []
            for tid, tid2, body, spans in zip(*[part.column(k).to_pylist() for k in range(4)]):
                kept, gone, runs, at = hashlib.sha256(), 0, 0, -1
                end = 0
                for span in sorted((s["begin"], s["end"]) for s in spans):
                    if span[0] > end or runs == 0:
                        kept.update(body[end : span[0]])
                        runs, at = runs + 1, span[0]
                    gone += max(0, span[1] - max(end, at))
                    end = max(end, span[1])
                kept.update(body[end:])
                out.append((tid, tid2, gone, runs, kept.hexdigest()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=["tid", "tid2", "gone", "runs", "kept_sha256"])


def _near(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT_ANCHORS else table


def marks(rows: DataFrame, window: int, gram: int, hot_segments: int, levels: tuple[int, ...] = FINER) -> DataFrame:
    """(key1, key2, begin, end) of the repeated bytes of segments: anchor, key1, key2, at, segment, n (occurrences)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.groupBy("anchor", "key1", "key2", "segment").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    hot = None
    if levels:
        sizes = rows.select("anchor", "key1", "key2").distinct().groupBy("anchor").count()
        hot = common.settle(sizes.filter(F.col("count") > hot_segments).select("anchor"), "repeat-hot")
        hot = None if hot.isEmpty() else hot
    rest = whole if hot is None else whole.join(_near(hot), "anchor", "left_anti")
    order = rest.select("anchor", "key1", "key2", "segment", "n").repartition(n, "anchor").sortWithinPartitions("anchor")
    found = common.arrow_map(order, _scan(window), "key1 long, key2 long, begin long, end long")
    if hot is None:
        return found
    cut = whole.join(_near(hot), "anchor", "left_semi").select("anchor", "key1", "key2", "at", "segment", "n")
    cut = common.settle(keyed(common.arrow_map(cut, _refine(levels[0], window, gram), FINER_ROWS)), "repeat-finer")
    inner = common.settle(marks(cut, window, gram, hot_segments, levels[1:]), "repeat-finer-marks")
    ups = cut.select("key1", "key2", "up1", "up2", "delta").distinct()
    lifted = inner.join(ups, ["key1", "key2"]).select(F.col("up1").alias("key1"), F.col("up2").alias("key2"), (F.col("begin") + F.col("delta")).alias("begin"), (F.col("end") + F.col("delta")).alias("end"))
    return found.unionByName(lifted)


def keyed(cut: DataFrame) -> DataFrame:
    """Segments named by 128 bits of their anchor and bytes."""
    return cut.withColumn("key1", F.xxhash64("anchor", "segment")).withColumn("key2", F.xxhash64("segment", "anchor"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(tid, tid2, spans) of the bytes in repeats across different texts or within one, overlapping; texts: tid, tid2, body."""
    if not gram < window <= LONGEST_WINDOW:
        raise ValueError(f"a window has over {gram} and up to {LONGEST_WINDOW} bytes")
    found = common.settle(common.arrow_map(texts.select("tid", "body"), _anchors(window, gram), "anchor long, tid long, place long"), "repeat-anchors")
    spot = F.xxhash64("tid", F.shiftright("place", 32))
    often = found.groupBy("anchor").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("n")).filter("a <> b").select("anchor", "n")
    often = common.settle(often, "repeat-often")
    hot = F.col("n") > found.count() / HOT_PLACES
    frequent = F.broadcast(often.filter(hot).select("anchor"))  # fewer than HOT_PLACES
    hits = found.join(frequent, "anchor", "left_semi").unionByName(found.join(frequent, "anchor", "left_anti").join(often.filter(~hot).select("anchor"), "anchor", "left_semi"))
    hits = common.settle(hits.groupBy("tid").agg(F.collect_list(F.struct("anchor", "place")).alias("hits")), "repeat-hits")  # a text's own anchors
    common.discard(found, often)
    cut = common.arrow_map(texts.join(hits, "tid").select("tid", "tid2", "body", "hits"), _cut(window), "anchor long, tid long, tid2 long, first long, at long, segment binary")
    cut = common.settle(keyed(cut), "repeat-segments")
    common.discard(hits)
    marked = common.settle(marks(cut.withColumn("n", F.lit(1).cast("long")), window, gram, hot_segments), "repeat-marks")
    spans = cut.select("tid", "tid2", "first", "key1", "key2").join(marked, ["key1", "key2"])
    spans = spans.select("tid", "tid2", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))
    spans = spans.distinct().groupBy("tid", "tid2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # a text's own spans
    out = common.settle(spans, "repeat-spans")
    common.discard(cut, marked)
    return out


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.bytes_of().alias("body"))
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    rows = body.select("doc_id", F.sha2("body", 256).alias("sha"), F.octet_length("body").cast("long").alias("n_bytes"))
    rows = common.settle(rows.withColumn("tid", half(1)).withColumn("tid2", half(17)), "repeat-rows")

    once = common.arrow_map(body.filter(F.octet_length("body") >= window).select("body"), _once, "tid long, tid2 long, body binary")
    once = once.repartition(n, "tid").dropDuplicates(["tid", "tid2"])
    # a table of the session, as only tables can be bucketed; it is dropped when it has been read
    name, path = f"repeat_texts_{uuid.uuid4().hex[:12]}", common.new_path(spark, "repeat-texts")
    try:
        with common.shuffles_end_with_their_job(spark):
            once.write.bucketBy(n, "tid").option("compression", "zstd").option("path", path).saveAsTable(name)
        texts = spark.table(name)
        spans = repeated_spans(texts, window, gram, hot_segments)
        # one text has this tid, but for collisions, which the second half tells apart after the bucketed join
        named = spans.withColumnRenamed("tid2", "_tid2")
        left = texts.join(named, "tid").filter((F.col("tid2") >= F.col("_tid2")) & (F.col("tid2") <= F.col("_tid2")))
        left = common.settle(common.arrow_map(left.select("tid", "tid2", "body", "spans"), _remove, "tid long, tid2 long, gone long, runs long, kept_sha256 string"), "repeat-kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    common.delete(spark, path)
    common.discard(spans)
    copies = rows.groupBy("tid", "tid2").agg(F.count("*").alias("copies"))
    facts = copies.join(left, ["tid", "tid2"], "left")
    out = rows.join(facts, ["tid", "tid2"])
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("gone", none)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("runs", none)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(common.docs_of(spark, sf_dir))
