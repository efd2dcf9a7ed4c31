"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share the corpus's words.
  A target stops at `max_epochs` times its source's size; the excess goes to the others by weight.
  With the sources sorted by cap over weight, those that stop are a prefix, so one pass over running
  sums gives the final share.
* Blocks: a source's documents stand in a shuffled order (by the MD5 of seed and doc_id) and are cut
  into blocks of `block_words`; the last block is shorter. Positions come from sums over ranges of the
  hash, so a source with a third of all rows is laid out by many tasks.
* Schedule: slot i has the golden-ratio point frac(i * phi), held in 40 bits, which falls into one
  source's part of the cumulative weights. A slot's rank within its source says which block it takes:
  ranks go round the source's blocks, epoch after epoch, until its target is met; the last slot is cut.
  Each stretch of 2.7/w points meets an interval of width w, so four points a slot meet every demand.
* Joining slots with blocks gives the words that the mix takes of each document, and the slots in which
  it takes them: the order in which `repeat_documents` writes the mix.

Defined results: null text has size 0, takes nothing and has no slot; a source without words has target
0; repeated rows each have their own place; rows without doc_id are shuffled by their text; no document
exceeds `max_epochs` times its size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm import common

BLOCK_WORDS = 1024
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
#: Points are multiples of 2^-40; this is the odd number nearest to 2^40 / golden ratio.
POINT_BITS = 40
STEP = round((1 << POINT_BITS) * (5**0.5 - 1) / 2) | 1
#: Points made for each slot of demand.
POINTS_A_SLOT = 4
#: Equal parts of the unit interval by which points meet sources.
CELL_BITS = 12


def _sized(batches):
    for batch in batches:
        for part in common.pieces_of(batch):
            sizes = [len(x.split()) for x in part.column(2).to_pylist()]  # bytes.split() is by ASCII white space
            yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes, pa.int64()), part.column(3)], names=["doc_id", "source", "size", "tie"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a tie-break of every row, without texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.bytes_of().alias("body"), F.xxhash64("text").alias("tie"))
    return common.arrow_map(rows, _sized, "doc_id long, source string, size long, tie long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_no, source, source_size, weight, target of each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("source_no", no)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("stops", F.col("cap").cast("decimal(38,0)") * F.col("left_weight") <= F.col("weight").cast("decimal(38,0)") * F.col("left"))
    # the first source that doesn't stop says what all such share by weight
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "source_no", "left", "left_weight"))).over(every)
    share = (F.col("weight") * first["left"]).cast("double") / first["left_weight"].cast("double")
    return per.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share)).select("source_no", "source", "source_size", "weight", "target")


def demand(per: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks, whole epochs, the words after them, and the slots that each source needs."""
    d = per.withColumn("words", F.round("target").cast("long")).filter("source_size > 0 AND words > 0")
    d = d.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    d = d.withColumn("epochs", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size"))
    d = d.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block_words)).cast("long"))
    up = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("high", F.sum("slots").over(up)).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    scale = lambda c: F.floor(F.col(c).cast("double") / F.col("all_slots") * F.lit(float(1 << POINT_BITS))).cast("long")
    return d.withColumn("low", F.col("high") - F.col("slots")).withColumn("from_point", scale("low")).withColumn("to_point", scale("high"))


def schedule(need: DataFrame) -> DataFrame:
    """slot, source_no, rank (of the slot within its source, from 0), for the slots that are used."""
    spark = need.sparkSession
    total = need.agg(F.max("all_slots")).first()[0] or 0
    slots = spark.range(POINTS_A_SLOT * total).withColumnRenamed("id", "slot")
    low, high = F.col("slot").bitwiseAND(F.lit((1 << 20) - 1)), F.shiftrightunsigned("slot", 20).bitwiseAND(F.lit((1 << 20) - 1))
    carried = F.pmod(high * F.lit(STEP), F.lit(1 << 20)) * F.lit(1 << 20)
    slots = slots.withColumn("point", F.pmod(low * F.lit(STEP) + carried, F.lit(1 << POINT_BITS)))
    shift = POINT_BITS - CELL_BITS
    parts = need.filter("to_point > from_point").select("source_no", "from_point", "to_point", "slots")
    parts = parts.withColumn("cell", F.explode(F.sequence(F.shiftright("from_point", shift), F.shiftright(F.col("to_point") - 1, shift))))
    hit = slots.withColumn("cell", F.shiftright("point", shift)).join(parts, "cell").filter("point >= from_point AND point < to_point")
    fine = F.floor(F.col("slot") / F.lit(max(1, POINTS_A_SLOT * total)) * F.lit(float(1 << 32))).cast("long")
    out = common.ranked(hit.select("slot", "source_no", "slots"), ["source_no"], [F.col("slot")], fine, F.lit(1).cast("long"), 256)
    return out.filter("before < slots").select("slot", "source_no", F.col("before").alias("rank"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null if nothing is taken), source, tie (hash of the text) and
    slots (of the block in which it begins, one an epoch) for every row of docs."""
    rows = common.settle(sized(docs), "mix-sizes")
    per = common.settle(targets(rows, weights, max_epochs), "mix-targets")
    need = common.settle(demand(per, block_words), "mix-demand")
    slots = schedule(need)

    placed = rows.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string")))).cast("binary")))
    fine = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    order = [F.col("order"), F.col("doc_id"), F.col("size"), F.col("tie")]
    placed = common.ranked(placed, ["source_no"], order, fine, F.col("size"))

    # a block's slots: whole epochs take it whole, the last epoch up to `cut` words
    used = slots.join(need.select("source_no", "blocks", "epochs", "rest"), "source_no")
    used = used.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    cut = F.least(F.lit(block_words), F.col("rest") - F.col("block") * block_words)
    whole = F.col("epoch") < F.col("epochs")
    used = used.groupBy("source_no", "block").agg(
        F.count_if(whole).alias("whole"), F.max(F.when(F.col("epoch") == F.col("epochs"), cut)).alias("cut"),
        F.min(F.when(whole, F.col("slot"))).alias("whole_slot"), F.min(F.when(~whole, F.col("slot"))).alias("cut_slot"), F.array_sort(F.collect_list("slot")).alias("slots"),  # one an epoch
    )

    # the parts of documents in blocks
    first, last = F.expr(f"before div {block_words}"), F.expr(f"(before + size - 1) div {block_words}")
    parts = placed.filter("size > 0").select("source_no", "order", "doc_id", "size", "tie", "before", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("before") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("before") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    parts = parts.withColumn("start", start).withColumn("end", end)
    got = parts.join(used, ["source_no", "block"])
    last = F.greatest(F.least(F.coalesce("cut", F.lit(0)), F.col("end")) - F.col("start"), F.lit(0))
    slot = F.when(F.col("whole") > 0, F.col("whole_slot")).when(last > 0, F.col("cut_slot"))
    # `before` is unique among rows with words
    taken = got.groupBy("source_no", "before").agg(F.sum(F.col("whole") * (F.col("end") - F.col("start")) + last).alias("taken"), F.min(slot).alias("first_slot"), F.min_by("slots", "block").alias("slots"))
    placed = placed.join(taken, (F.col("size") > 0) & (placed["source_no"] == taken["source_no"]) & (placed["before"] == taken["before"]), "left").drop(taken["source_no"]).drop(taken["before"])
    return placed.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "source", "tie", "slots")


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it, to the nearest whole document, in the order of the schedule.

    Rows that repeat a doc_id, source and text are each taken as often as the one that is taken most."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_gl{k}" for k in range(len(docs.columns))]
    id_, source, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text"))
    rows = mix(docs, **how).withColumn("times", F.expr("CASE WHEN size > 0 THEN cast(round(taken / size) AS int) ELSE 0 END")).filter("times > 0")
    times = rows.groupBy("doc_id", "source", "tie").agg(F.max("times").alias("times"), F.min("slots").alias("slots"))
    plain = docs.toDF(*names)
    same = id_.cast("long").eqNullSafe(F.col("doc_id")) & source.cast("string").eqNullSafe(F.col("source")) & (F.xxhash64(text) == F.col("tie"))
    out = plain.join(times, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    out = out.withColumn("slot", F.element_at("slots", F.least("copy", F.size("slots"))))
    return out.repartitionByRange(n, "slot").sortWithinPartitions("slot", "doc_id", "copy").select(*names).toDF(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.docs_of(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
ordered AS (
  SELECT *, CAST((no - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS rest_words,
    sum((no - 1) % 3 + 1) OVER () - coalesce(sum((no - 1) % 3 + 1) OVER b, 0) AS rest_weight
  FROM per WINDOW b AS (ORDER BY 3 * source_size / ((no - 1) % 3 + 1), no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, CAST(cap AS HUGEINT) * rest_weight <= CAST(weight AS HUGEINT) * rest_words AS stops FROM ordered),
open_share AS (SELECT rest_words, rest_weight FROM marked WHERE NOT stops ORDER BY cap / weight, no LIMIT 1),
aims AS (
  SELECT m.source, m.no, m.source_size,
    CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(m.weight * o.rest_words AS DOUBLE) / CAST(o.rest_weight AS DOUBLE) END AS target
  FROM marked m LEFT JOIN open_share o ON true),
needed AS (
  SELECT no, source_size, CAST(round(target) AS BIGINT) AS words, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS blocks FROM aims WHERE source_size > 0 AND round(target) > 0),
slotted AS (SELECT *, words // source_size AS epochs, words % source_size AS rest, (words // source_size) * blocks + CAST(ceil((words % source_size) / {BLOCK_WORDS}) AS BIGINT) AS slots FROM needed),
need AS (
  SELECT *, CAST(floor((sum(slots) OVER u - slots) / sum(slots) OVER () * {1 << POINT_BITS}) AS BIGINT) AS from_point, CAST(floor(sum(slots) OVER u / sum(slots) OVER () * {1 << POINT_BITS}) AS BIGINT) AS to_point
  FROM slotted WINDOW u AS (ORDER BY no)),
points AS (
  SELECT i AS slot, CAST(CAST(i AS HUGEINT) * {STEP} % {1 << POINT_BITS} AS BIGINT) AS point
  FROM (SELECT unnest(range(0, CAST({POINTS_A_SLOT} * coalesce((SELECT sum(slots) FROM need), 0) AS BIGINT))) AS i)),
hit AS (SELECT n.*, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM points JOIN need n ON point >= from_point AND point < to_point),
used AS (
  SELECT no, rank % blocks AS block, min(slot) FILTER (rank // blocks < epochs) AS whole_slot, min(slot) FILTER (rank // blocks >= epochs) AS cut_slot,
    max(least({BLOCK_WORDS}, rest - (rank % blocks) * {BLOCK_WORDS})) FILTER (rank // blocks = epochs) AS cut
  FROM hit WHERE rank < slots GROUP BY no, rank % blocks),
placed AS (
  SELECT doc_id, size, no, a.source_size, target, CAST(round(target) AS BIGINT) AS words,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
parts AS (SELECT doc_id, no, before, size, unnest(range(CAST(before // {BLOCK_WORDS} AS BIGINT), CAST((before + size - 1) // {BLOCK_WORDS} AS BIGINT) + 1)) AS block FROM placed WHERE size > 0),
firsts AS (
  SELECT doc_id, min(CASE WHEN whole_slot IS NOT NULL THEN whole_slot WHEN least(cut, before + size - p.block * {BLOCK_WORDS}) > before - p.block * {BLOCK_WORDS} AND cut > 0 THEN cut_slot END) AS first_slot
  FROM parts p JOIN used u ON p.no = u.no AND p.block = u.block GROUP BY doc_id)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - before)) END AS BIGINT) AS taken, first_slot
FROM placed LEFT JOIN firsts USING (doc_id)
"""
