import random

from pyspark.sql import functions as F

from gridledger.operators import snapshots as S
from gridledger.streaming import loads as L
from tests.conftest import rows_of
from tests.test_ingest import HARBOUR, STOCK, grid


def arrive(spark, src, **files):
    grid(spark, **files).coalesce(1).write.mode("append").parquet(src)


def test_only_changed_files(spark, tmp_path):
    """Content that is there already gives nothing, other content the next sequence, also after a restart."""
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: L.load_stream(spark, src, out, mark).awaitTermination()
    arrive(spark, src, harbour=HARBOUR)
    run()
    arrive(spark, src, harbour=HARBOUR, stock=STOCK)  # harbour is as before
    run()
    changed = [*HARBOUR[:-1], ["K7", "paint boom", "10"]]
    arrive(spark, src, harbour=changed)
    run()
    arrive(spark, src, harbour=changed)
    run()
    arrive(spark, src, harbour=HARBOUR)  # an earlier content is new again
    run()
    snapshots = spark.read.parquet(f"{out}/snapshots/*")
    assert rows_of(snapshots, "batch", "file", "sequence") == [(0, "harbour", 1), (1, "stock", 1), (2, "harbour", 2), (4, "harbour", 3)]
    data = spark.read.parquet(f"{out}/data/*").groupBy("batch", "file").count()
    assert rows_of(data, "batch", "file", "count") == [(0, "harbour", 4), (1, "stock", 3), (2, "harbour", 4), (4, "harbour", 4)]


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    arrive(spark, src, harbour=HARBOUR)
    load = L.ingest.load

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(L.ingest, "load", stop)
    query = L.load_stream(spark, src, out, mark)
    try:
        query.awaitTermination()
    except Exception:
        pass
    assert query.exception() is not None
    monkeypatch.setattr(L.ingest, "load", load)
    L.load_stream(spark, src, out, mark).awaitTermination()
    assert rows_of(spark.read.parquet(f"{out}/snapshots/*"), "batch", "file", "sequence") == [(0, "harbour", 1)]


def test_stream_equals_batch(spark, tmp_path):
    """Random arrivals, one file a batch, against only_changed and next_sequence wave by wave."""
    rnd, src, mark, out = random.Random(4), str(tmp_path / "in"), str(tmp_path / "mark"), str(tmp_path / "out")
    known = spark.createDataFrame([], "file string, content_hash string, row_count long, sequence long")
    want = []
    for wave in range(4):
        files = {f"f{k}": [["A", "B"], ["x", str(rnd.randint(0, 1))]] for k in range(4) if rnd.random() < 0.8}
        arrive(spark, src, **files)
        told = L.contents(grid(spark, **files))
        current = S.current_snapshots(known, ["file"]).drop("snapshots")
        new = S.next_sequence(S.only_changed(told, current, ["file"]), known, ["file"])
        rows = [tuple(r) for r in new.select("file", "content_hash", "row_count", "sequence").collect()]
        want += [(wave, *r) for r in rows]
        known = spark.createDataFrame([tuple(r) for r in known.collect()] + rows, known.schema)
        L.changes(spark, src).writeStream.foreachBatch(lambda df, n: df.drop("path").withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b{n}")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = rows_of(spark.read.parquet(f"{out}/*"), "batch", "file", "content_hash", "row_count", "sequence")
    assert got == sorted(want)


def test_a_call_for_many_files():
    """Files of a bucket are read and kept by one call to the state, in parts of any size, each with its own versions."""
    import pandas as pd

    class Value:
        held, calls = None, 0

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.calls = value, self.calls + 1

    value, series = Value(), L.Series()
    series.init(value)
    row = lambda f, p, w: {"file": f, "path": p, "bucket": 0} | {f"w{k}": (1 << 32) - 1 - w for k in range(L.WORDS)}
    tell = lambda *parts: sorted((tuple(r) for out in series.handleInputRows((0,), iter(pd.DataFrame(p) for p in parts), None) for r in out.itertuples(index=False)), key=repr)
    first = tell([row(f"f{i % 50}", "a", i) for i in range(100)], [row("f7", "b", 3), row(None, "c", 4)])
    assert value.calls == 1 and len(first) == 52 and {r[3] for r in first} == {1}
    assert [(r[1], r[4]) for r in first if r[0] == "f7"] == [("a", 3), ("b", 3)] and {r[2] for r in first if r[0] == "f7"} == {L.content_hash([3 * ((1 << 32) - 1) - 67] * L.WORDS, 3)}
    again = tell([row(f"f{i % 50}", "d", i) for i in range(100)], [row("f7", "d", 3), row(None, "d", 5)])  # only the last is other
    assert [(r[0], r[1], r[3], r[4]) for r in again] == [(None, "d", 2, 1)] and value.calls == 2
    assert tell([row("f1", "e", 1), row("f1", "e", 51)]) == [] and value.calls == 2
