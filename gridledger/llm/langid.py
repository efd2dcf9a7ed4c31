"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For each bit, a binary classifier over hashed byte n-grams (1 to 4
bytes of the lower-cased text, ASCII non-letters as word ends) is fitted: the log ratio of the n-gram
shares in languages with and without the bit, so every language counts alike. A text's bit margins meet
the codewords by logistic loss, each bit weighted by how well it did on the training sample; the nearest
codeword wins, and texts with a second codeword nearly as near are flagged as ambiguous.

Training uses at most `sample` documents of each language, those with the smallest hash of doc_id: hashes
below a bound of a few times the sample are ranked, so that no task ranks a large language. Every fifth
document of the sample weighs the bits and is not counted. What reaches the driver is one number for each
language and hash bucket.

Defined results: a text that is null or has no letter gets 'und' with score 0, as does every text if
nothing was learned; rows without language don't train; with one language all texts are given it; of
languages that are equally near the first by code point is given;
repeated rows get equal results; long texts are counted whole, in slices that end at white space and carry
their last bytes over, so that n-grams are as if there were none; an empty table gives no rows; other columns
are not read (keep_languages passes them on, whatever their names, if Arrow has their type).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from gridledger.llm import common

#: Training documents of each language.
SAMPLE = 2000
#: Up to so many ids of training documents are broadcast; more are joined.
SENT_IDS = 1_000_000
#: Ids below the bound on hashes, for each one of the sample.
RANKED_IDS = 2
#: Of so many sampled documents one weighs the bits.
WEIGHING = 5
BUCKET_BITS = 14
GRAMS = (1, 2, 3, 4)
#: Counts added to each bucket.
SMOOTHING = 0.5
#: N-grams of one text overlap, so their evidence is scaled down.
EVIDENCE = 0.25
#: Margins beyond this say no more.
LARGEST_MARGIN = 20.0
#: Scores below this are flagged.
SURE = 0.8
UNKNOWN = "und"
SLICE = 1 << 20

_SPACE = re.compile(r"[ \t\n\r]")
_ENDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _slices(text: str, size: int):
    """Parts of at least `size` characters that end at white space, or with the text."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def grams(text: str, size: int = SLICE) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    carried, words = b"", False
    for part in _slices(text, size):
        plain = b" ".join(part.lower().encode().translate(_ENDS).split())
        if plain:
            carried = _add_grams(counts, carried, (b"" if words else b" ") + plain + b" ")
            words = True
    if not words:
        _add_grams(counts, b"", b"  ")
    return counts


def _add_grams(counts: np.ndarray, before: bytes, new: bytes) -> bytes:
    """Count the n-grams that end in `new`; returns the bytes that the next part's n-grams may begin with."""
    for n in GRAMS:
        b = np.frombuffer(before[len(before) - (n - 1) :] if n > 1 and before else b"", np.uint8)
        b = np.concatenate([b, np.frombuffer(new, np.uint8)]).astype(np.uint64)
        if len(b) < n:
            continue
        key = np.full(len(b) - n + 1, n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | b[k : len(b) - n + 1 + k]
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        counts += np.bincount(key.astype(np.int64), minlength=1 << BUCKET_BITS)
    return (before + new)[-(max(GRAMS) - 1) :]


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits for up to 6 languages, else the best of some fixed random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = (np.arange(1, 1 << (n - 1))[None, :] >> np.arange(n)[:, None]) & 1
        return (2 * bits - 1).astype(np.int8)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(60):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, abs(code.sum(axis=0)) < n]
        apart = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + 10_000 * np.eye(n, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]) if len(langs) else counts
        columns = []
        for bit in self.code.T:
            if (bit > 0).all() or not len(langs):
                columns.append(np.full(1 << BUCKET_BITS, 1.0))
            else:
                columns.append(np.log(share[bit > 0].mean(axis=0) / share[bit < 0].mean(axis=0)))
        self.pull = np.array(columns).T
        self.trust = np.ones(self.code.shape[1])

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return np.clip(EVIDENCE * (counts @ self.pull), -LARGEST_MARGIN, LARGEST_MARGIN)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is ambiguous)"""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        loss = np.logaddexp(0, -self.code * self.margins(grams(text))) @ self.trust
        near = np.exp(loss.min() - loss)
        score = float(near.max() / near.sum())
        return self.langs[int(loss.argmin())], score, score < SURE


def held_out() -> Column:
    """Rows that never train: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[lang] = sums.get(lang, 0) + grams(text)
    for lang, counts in sums.items():
        used = np.nonzero(counts)[0]
        yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["lang", "bucket", "n"])


def _judge(held):
    def run(batches):
        model = held.value
        place = {lang: k for k, lang in enumerate(model.langs)}
        right, n = np.zeros(model.code.shape[1]), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in place:  # a language whose only documents weigh
                    continue
                right += model.code[place[lang]] * model.margins(grams(text)) > 0
                n += 1
        yield pa.record_batch([pa.array(range(len(right)), pa.int32()), pa.array(right.astype(np.int64)), pa.array([n] * len(right), pa.int64())], names=["bit", "good", "n"])

    return run


def sampled(known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """_lang, _id, _rank of at most `sample` ids of each language, those with the smallest hashes."""
    ids = common.settle(known.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")).distinct(), "lang-all-ids")
    n = ids.groupBy("_lang").agg(F.count("*").alias("_n"))
    # hashes spread evenly: a bound for RANKED_IDS times the sample leaves fewer than the sample with no real chance
    part = F.least(F.lit(1.0), F.lit(float(RANKED_IDS * sample)) / F.col("_n"))
    low = ids.withColumn("_hash", F.xxhash64("_id")).join(n, "_lang").filter(F.shiftrightunsigned("_hash", 11) <= part * F.lit(float(1 << 53)))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_id"))
    return low.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select("_lang", "_id", "_rank")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    ids = common.settle(sampled(known, sample), "lang-ids")
    # at most `sample` ids for each language; they are sent to all tasks only if they are few
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    weighs = (F.pmod("_rank", F.lit(WEIGHING)) == 0).alias("weighs")
    chosen = known.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text", weighs)
    chosen = common.settle(chosen, "lang-sample")
    sums = common.arrow_map(chosen.filter("NOT weighs"), _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in sums})
    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in sums:
        counts[place[r.lang], r.bucket] = r.n
    model = Model(langs, counts)
    if langs:
        held = spark.sparkContext.broadcast(model)  # languages and buckets bound its size
        good = common.arrow_map(chosen.filter("weighs"), _judge(held), "bit int, good long, n long").groupBy("bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
        for r in good:
            share = min(max(r.good / max(r.n, 1), 0.51), 0.999)
            model.trust[r.bit] = np.log(share / (1 - share))
        model.trust /= model.trust.mean()
    return model


def _predict(held, keep: int):
    """Predict from the last column; the first `keep` columns are passed on."""

    def run(batches):
        model = held.value
        for batch in batches:
            for part in common.pieces_of(batch):
                seen: dict[str | None, tuple] = {}
                rows = []
                for text in part.column(batch.num_columns - 1).to_pylist():
                    if text not in seen:
                        seen[text] = model.predict(text)
                    rows.append(seen[text])
                if rows:
                    lang, score, vague = zip(*rows)
                    new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_())]
                    yield pa.record_batch([*part.columns[:keep], *new], names=[*part.schema.names[:keep], "lang_pred", "score", "ambiguous"])

    return run


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows without their last column, the text, and with lang_pred, score and ambiguous."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    keep = rows.schema.fields[:-1]
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    return common.arrow_map(rows, _predict(held, len(keep)), StructType([*keep, *new]))


def keep_languages(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """docs in a wanted language (any learned one by default), with the predicted language as their lang.

    Rejected are texts without a letter, other languages, and ambiguous texts."""
    names = [f"_gl{k}" for k in range(len(docs.columns))]
    of = {c: n for c, n in zip(docs.columns, names)}
    found = predict(docs.toDF(*names).withColumn("_gl_text", F.col(of["text"])), train(docs))
    found = found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    if languages is not None:
        found = found.filter(F.col("lang_pred").isin(languages))
    return found.select(*[F.col("lang_pred" if c == "lang" else of[c]).alias(c) for c in docs.columns])


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.docs_of(spark, sf_dir)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
