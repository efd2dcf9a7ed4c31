from collections import Counter, defaultdict

from gridledger.llm import sharding
from tests.llm.helpers import docs


def shards_by_text(spark, rows):
    text = dict(rows)
    got, sizes = defaultdict(set), Counter()
    for r in sharding.shard(docs(spark, rows)).collect():
        got[text[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
    return got, sizes


def whole_and_split(spark, rows):
    got, sizes = shards_by_text(spark, rows)
    group, target = Counter(), sum(sizes.values()) / sharding.SHARDS
    for _, t in rows:
        group[t] += len(t.encode()) + sharding.ROW_BYTES
    for t, shards in got.items():
        assert len(shards) == 1 if group[t] <= sharding.WHOLE_SHARE * target else len(shards) <= -(-group[t] // (sharding.WHOLE_SHARE * target))
    return got, sizes


def test_groups_that_fit_stay_in_one_shard(spark):
    """Copies on a small table, and groups of up to half a shard on a skewed one; a hot group is split."""
    whole_and_split(spark, [(i, f"few copies {i // 2}") for i in range(200)])
    rows = [(i, f"text number {i} " * 5) for i in range(2400)] + [(10_000 + i, f"copied text {i // 60}") for i in range(1200)]
    rows += [(20_000 + i, "hot copies " * 6) for i in range(1500)]
    got, sizes = whole_and_split(spark, rows)
    assert len(got["hot copies " * 6]) > 4 and max(sizes.values()) / min(sizes.values()) < 1.1


def test_groups_of_the_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole_and_split(spark, [(r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect()])


def test_slots_are_places(spark):
    rows = [(i, "same " * 4) for i in range(300)] + [(1000 + i, f"other {i}") for i in range(500)]
    got = defaultdict(list)
    for r in sharding.shard(docs(spark, rows)).collect():
        got[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in got.values())
