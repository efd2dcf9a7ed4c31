"""SentencePiece encoding and decoding: sampled segmentations of the piece lattice.

The pieces of a public SentencePiece model form a lattice over a text: an arc for each piece that
matches, or the byte pieces of a character without a piece of its own. Forward filtering sums the
weights of all paths to a position; backward sampling draws, from a text's end, the arc by which it was
reached, in proportion to these sums: exact draws from all segmentations. Draws are numbers made from
the row key and the position, so they don't depend on batches, order or retries.

No piece crosses the end of a word (spaces belong to the next word) or a line break, so words are
independent parts of the lattice. Each different word of a batch is filtered once, WORD_CHARS characters of
them together, and all draws from these go on side by side; then their lattices go, so that a task's memory doesn't hold
those of a whole batch. The model's pieces have ranks, not probabilities; a piece weighs
1 / (rank + offset) to the power `alpha`.

Decoding joins the pieces' bytes and gives the text back exactly, whatever its white space or characters.
The model's file is sent to the tasks, whose machines need not have it.

Defined results: null counts as the empty text, which has no pieces; a null doc_id is key 0; rows with
one doc_id and text get the same draw; texts are encoded whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 11
ALPHA = 1.0
RANK_OFFSET = 10
#: Weight of a character that has only byte pieces.
FALLBACK_LOG = -12.0
#: Characters that a task encodes together; longer texts are alone.
BATCH_CHARS = 1 << 21
#: Characters of different words that a task filters together; longer words are alone.
WORD_CHARS = 1 << 16
#: Marks a space at the front of pieces.
SPACE = "▁"


class Pieces:
    """The pieces of a model: a trie over their characters, their ids, weights and bytes."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        texts: dict[str, int] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.raw.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.raw.append(text.encode())
                texts[text] = k
        if any(" " in p.lstrip(" ") or "\n" in p for p in texts):
            raise ValueError("a piece crosses the end of a word")
        self.bytes_of = pa.array(self.raw, pa.large_binary())
        self.weights = -alpha * np.log(np.arange(len(self.raw)) + float(RANK_OFFSET))
        letters = sorted({ord(c) for p in texts for c in p})
        self.letters = np.zeros(max(letters) + 2, np.int64)  # by code point; 0 for characters in no piece
        self.letters[letters] = np.arange(1, len(letters) + 1)
        self.spread = len(letters) + 1
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for text, k in texts.items():
            node = 0
            for c in text:
                node = steps.setdefault(node * self.spread + int(self.letters[ord(c)]), len(steps) + 1)
            ends[node] = k
        self.bits = max(1, (8 * len(steps)).bit_length())
        self._hash(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def _hash(self, steps: np.ndarray, to: np.ndarray) -> None:
        """A table of steps by their hash; those that meet in a place stand in the next free one."""
        self.step_at, self.to_at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        place = self.place(steps)
        self.tries = 0
        while len(steps):
            self.tries += 1
            free = self.step_at[place] < 0
            _, first = np.unique(place, return_index=True)
            takes = np.zeros(len(steps), bool)
            takes[first] = True
            takes &= free
            self.step_at[place[takes]], self.to_at[place[takes]] = steps[takes], to[takes]
            steps, to, place = steps[~takes], to[~takes], (place[~takes] + 1) & ((1 << self.bits) - 1)

    def place(self, steps: np.ndarray) -> np.ndarray:
        return ((steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def walk(self, steps: np.ndarray) -> np.ndarray:
        """The node that each step leads to, or -1."""
        place, out = self.place(steps), np.full(len(steps), -1, np.int64)
        held = self.step_at[place]
        same = held == steps
        out[same] = self.to_at[place[same]]
        open_ = np.nonzero(~same & (held >= 0))[0]
        for _ in range(self.tries - 1):
            if not len(open_):
                break
            place_ = place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            held = self.step_at[place_]
            same = held == steps[open_]
            out[open_[same]] = self.to_at[place_[same]]
            open_ = open_[~same & (held >= 0)]
        return out

    def decode(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[k] for k in ids])


@lru_cache(maxsize=2)
def pieces_of_model(path: str = MODEL, alpha: float = ALPHA) -> Pieces:
    """A process reads a model once."""
    return Pieces(path, alpha)


class Lattice:
    """The filtered lattices of different words: for each end of an arc, its arcs with cumulative probabilities.

    Node first[w] + j stands for position j of word w, from 0 on. The arcs to a node stand together from
    head[node] on, with their probabilities summed up. All words are filtered together, position by position."""

    def __init__(self, pieces: Pieces, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(points)) + word  # node before each character
        last = self.first[word] + sizes[word]
        letter = np.where(points < len(pieces.letters), pieces.letters[np.minimum(points, len(pieces.letters) - 1)], 0)
        froms, tos, ids = [], [], []
        alive, node, plain = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        size = 0
        while len(alive):
            node = pieces.walk(node * pieces.spread + letter[alive + size])  # letter 0 is in no step
            on = node >= 0
            alive, node = alive[on], node[on]
            size += 1
            hit = pieces.piece[node] >= 0
            froms.append(start[alive[hit]])
            tos.append(start[alive[hit]] + size)
            ids.append(pieces.piece[node[hit]])
            if size == 1:
                plain[alive[hit]] = False
            more = start[alive] + size < last[alive]
            alive, node = alive[more], node[more]
        # characters without a piece of their own
        froms.append(start[plain])
        tos.append(start[plain] + 1)
        ids.append(np.full(int(plain.sum()), -1))
        # to each node the longest arcs first: they are drawn most
        from_, to, id_ = np.concatenate(froms[::-1]), np.concatenate(tos[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(to, kind="stable")
        from_, to, self.ids = from_[order], to[order], id_[order].astype(np.int32)
        self.lengths, self.head = to - from_, np.zeros(self.first[-1], np.int64)
        self.ups = self._filter(from_, to, np.where(self.ids < 0, FALLBACK_LOG, pieces.weights[self.ids]))

    def _filter(self, from_: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
        sums, ups = np.zeros(self.first[-1]), np.zeros(len(to))
        if not len(to):
            return ups
        heads = np.concatenate([[0], np.nonzero(np.diff(to))[0] + 1])  # first arc to each node
        tails = np.concatenate([heads[1:], [len(to)]])
        nodes = to[heads]
        self.head[nodes] = heads
        depth = nodes - self.first[np.searchsorted(self.first, nodes, "right") - 1]  # position within the word
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth)[1:])])
        for a, b in zip(cuts[:-1], cuts[1:]):
            group = by_depth[a:b]
            n = tails[group] - heads[group]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            arcs = np.repeat(heads[group] - begin, n) + np.arange(int(n.sum()))
            logs = sums[from_[arcs]] + weight[arcs]
            most = np.maximum.reduceat(logs, begin)
            share = np.exp(logs - np.repeat(most, n))
            total = np.add.reduceat(share, begin)
            sums[nodes[group]] = most + np.log(total)
            share /= np.repeat(total, n)
            up = np.cumsum(share)
            up -= np.repeat(up[begin] - share[begin], n)
            up[begin + n - 1] = 1.0
            ups[arcs] = np.minimum(up, 1.0)
        return ups

    def draw(self, words: np.ndarray, ends: np.ndarray, keys: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
        """Write the piece that ends at a character to its place in `out`: an id, or -1 for byte pieces.

        words: numbers of the words that stand in the texts; ends: their ends among all characters;
        keys, starts: row key and first character of their texts."""
        base = self.first[words]
        nodes = self.first[words + 1] - 1
        while len(nodes):
            arc, drawn = self.head[nodes], uniform(keys, ends - starts)
            past = np.nonzero(self.ups[arc] <= drawn)[0]
            while len(past):
                arc[past] += 1
                past = past[self.ups[arc[past]] <= drawn[past]]
            out[ends - 1] = self.ids[arc]
            step = self.lengths[arc]
            nodes, ends = nodes - step, ends - step
            on = nodes > base
            nodes, base, ends, keys, starts = nodes[on], base[on], ends[on], keys[on], starts[on]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key and place."""
    x = mixed(keys + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(12)).astype(np.float64) * 2.0**-52


def row_key(doc_id: int | None, seed: int = SEED) -> int:
    return int(mixed(np.array([((doc_id or 0) + (seed << 48)) % (1 << 64)], np.uint64))[0])


_WORDS = re.compile(r" *[^ \n]+| +|\n")


def _stretches(lengths: np.ndarray):
    """(first, end) of different words of at most WORD_CHARS characters, unless one word has more."""
    up, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(up, (up[a - 1] if a else 0) + WORD_CHARS, "right")))
        yield a, b
        a = b


def encode_batch(pieces: Pieces, doc_ids: list, texts: list[str], seed: int = SEED) -> list[np.ndarray]:
    """The sampled ids of each text."""
    known: dict[str, int] = defaultdict(count().__next__)
    numbers = [np.fromiter(map(known.__getitem__, _WORDS.findall(t)), np.int32) for t in texts]
    counts = np.fromiter(map(len, numbers), np.int64, len(texts))
    number = np.concatenate([np.zeros(0, np.int32), *numbers])
    different = list(known)
    del known, numbers
    lengths = np.fromiter(map(len, different), np.int64, len(different))
    ends = np.cumsum(lengths[number])
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(chars)])
    keys = np.array([row_key(d, seed) for d in doc_ids], np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    at = np.full(int(first[-1]), -2, np.int32)
    order = np.argsort(number, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(different)))])  # of each word's places in that order
    for a, b in _stretches(lengths):
        own = order[begins[a] : begins[b]]
        Lattice(pieces, different[a:b]).draw(number[own] - a, ends[own], keys[row[own]], first[row[own]], at)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = []
    for k in range(len(texts)):
        part, cp = at[first[k] : first[k + 1]], points[first[k] : first[k + 1]]
        ends = np.nonzero(part != -2)[0]
        ids = part[ends]
        if (bare := ids == -1).any():
            alone = cp[ends[bare]]
            wide = np.ones(len(ids), np.int64)
            wide[bare] = 1 + (alone >= 0x80) + (alone >= 0x800) + (alone >= 0x10000)
            ids, spread = np.repeat(ids, wide), np.repeat(bare, wide)
            ids[spread] = pieces.byte_ids[np.frombuffer(alone.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        out.append(ids)
    return out


OUT = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean, ids array<int>"


def _parts(batch):
    """(first row, texts) of at most BATCH_CHARS characters, unless one text has more."""
    texts, size, at = [], 0, 0
    for k, text in enumerate(map(pa.StringScalar.as_py, batch.column(1))):
        if texts and size + len(text) > BATCH_CHARS:
            yield at, texts
            at, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield at, texts


def _encoded(pieces: Pieces, part, at: int, texts: list[str], seed: int):
    """The result's rows of a part's texts from row `at` on."""
    keys = part.column(0).slice(at, len(texts))
    found = encode_batch(pieces, keys.to_pylist(), texts, seed)
    lists, rows = lists_of(found), []
    for text, ids, back in zip(texts, found, texts_of(pieces, lists)):
        rows.append((len(text), len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))]
    names = ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "lossless", "ids", *part.schema.names[2:]]
    return pa.record_batch([keys, *columns, lists, *part.slice(at, len(texts)).columns[2:]], names=names)


def lists_of(found: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def texts_of(pieces: Pieces, lists: pa.Array) -> list[bytes]:
    """What each list of ids decodes to: the bytes of all their pieces stand together, and each list's are a stretch."""
    flat = pieces.bytes_of.take(lists.flatten())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2].to_pybytes() if len(flat) and flat.buffers()[2] is not None else b""
    at = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])].tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def _sample(model: str, alpha: float, seed: int):
    def run(batches):
        pieces = pieces_of_model(common.local_file(model), alpha)
        for batch in batches:
            for part in common.pieces_of(batch):
                for at, texts in _parts(part):
                    yield _encoded(pieces, part, at, texts, seed)

    return run


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_chars, n_pieces, digests of the ids and of what they decode to, whether that is the text (lossless), the
    ids, and the columns to keep, for every row."""
    kept = [docs[c].alias(f"kept_{c}") for c in keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    out = common.arrow_map(rows, _sample(common.send_file(docs.sparkSession, model), alpha, seed), OUT + more)
    return out.withColumnsRenamed({f"kept_{c}": c for c in keep})


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    name = common.send_file(rows.sparkSession, model)

    def run(batches):
        pieces = pieces_of_model(common.local_file(name))
        for batch in batches:
            for part in common.pieces_of(batch):
                texts = [x.decode() for x in texts_of(pieces, part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.arrow_map(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.docs_of(spark, sf_dir))
