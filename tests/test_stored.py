import pytest

from gridledger.sources import stored as X
from tests.conftest import rows_of

SNAPSHOT = "app string, release string, layer string, snapshot_id string, file string, period int"
RECORD = "app string, release string, layer string, snapshot_id string, n int"


def load(spark, root, *loads):
    """loads: (layer, snapshot_id, file, period, rows)."""
    snapshots = spark.createDataFrame([("a", "r/1", layer, i, file, period) for layer, i, file, period, _ in loads], SNAPSHOT)
    records = spark.createDataFrame([("a", "r/1", layer, i, n) for layer, i, _, _, rows in loads for n in rows], RECORD)
    X.load_snapshots(root, snapshots, records)


def held(spark, root):
    return rows_of(X.stored_records(spark, root), "layer", "snapshot_id", "n")


def test_a_load_run_again_leaves_no_row_twice(spark, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        load(spark, root, ("l", "007", "f", 1, [1, 2]), ("l", "8", "g", 1, [3]), ("m", "8", "g", 1, [4]))
    assert held(spark, root) == [("l", "007", 1), ("l", "007", 2), ("l", "8", 3), ("m", "8", 4)]
    load(spark, root, ("l", "007", "f", 2, [5]))  # replaces, others stay
    assert held(spark, root) == [("l", "007", 5), ("l", "8", 3), ("m", "8", 4)]
    assert rows_of(X.stored_snapshots(spark, root), "layer", "snapshot_id", "period") == [("l", "007", 2), ("l", "8", 1), ("m", "8", 1)]
    load(spark, root, ("l", "8", "g", 1, []))  # a load without rows
    assert held(spark, root) == [("l", "007", 5), ("m", "8", 4)]


@pytest.mark.parametrize("steps", [0, 1])
def test_a_stopped_load(spark, tmp_path, monkeypatch, steps):
    """Stopped at any step, a load's rows don't count, or count once; run again, it is as if it had not stopped."""
    root, done, replace = str(tmp_path), [0], X._replace
    load(spark, root, ("l", "1", "f", 1, [1]))

    def stop(df, path, partitions):
        if done[0] == steps:
            raise RuntimeError("stopped")
        done[0] += 1
        replace(df, path, partitions)

    monkeypatch.setattr(X, "_replace", stop)
    with pytest.raises(RuntimeError):
        load(spark, root, ("l", "2", "f", 1, [2, 3]))
    assert held(spark, root) == [("l", "1", 1)]
    monkeypatch.setattr(X, "_replace", replace)
    load(spark, root, ("l", "2", "f", 1, [2, 3]))
    assert held(spark, root) == [("l", "1", 1), ("l", "2", 2), ("l", "2", 3)]


def test_changes_touch_their_scopes_only(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, ("l", "1", "f", 1, [1]), ("l", "2", "g", 1, [2]), ("m", "3", "f", 1, [3]), ("n", "4", "f", 1, [4]))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshots").rglob("layer=m/*.parquet")}
    scope = ("a", "r/1")
    for _ in range(2):  # each may be run again
        X.correct_periods(spark, root, spark.createDataFrame([(*scope, "l", "2", 9)], "app string, release string, layer string, snapshot_id string, new_period int"))
        X.move_files(spark, root, spark.createDataFrame([(*scope, "l", "f", "h")], "app string, release string, layer string, file string, new_file string"))
        X.delete_snapshots(spark, root, spark.createDataFrame([(*scope, "n", "4")], "app string, release string, layer string, snapshot_id string"))
    assert rows_of(X.stored_snapshots(spark, root), "layer", "snapshot_id", "file", "period") == [("l", "1", "h", 1), ("l", "2", "g", 9), ("m", "3", "f", 1)]
    assert held(spark, root) == [("l", "1", 1), ("l", "2", 2), ("m", "3", 3)]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshots").rglob("layer=m/*.parquet")}
    assert not list((tmp_path / "records").rglob("layer=n/*/*.parquet"))


def test_a_stopped_delete(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    load(spark, root, ("l", "1", "f", 1, [1]), ("l", "2", "g", 1, [2]))
    gone = spark.createDataFrame([("a", "r/1", "l", "1")], "app string, release string, layer string, snapshot_id string")
    drop = X.drop_partitions

    def stop(spark, path, *rest):
        if path.endswith("records"):
            raise RuntimeError("stopped")
        drop(spark, path, *rest)

    monkeypatch.setattr(X, "drop_partitions", stop)
    with pytest.raises(RuntimeError):
        X.delete_snapshots(spark, root, gone)
    assert held(spark, root) == [("l", "2", 2)]
    monkeypatch.setattr(X, "drop_partitions", drop)
    X.delete_snapshots(spark, root, gone)
    assert held(spark, root) == [("l", "2", 2)] and not list((tmp_path / "records").rglob("snapshot_id=1/*.parquet"))
