"""Versioned snapshots: keys, fingerprints, diffs, history, matching files to layers.

`snapshots` has snapshot_id, layer, file, sequence, created_at and more; rows are keyed by `by` columns
(usually file) and a row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import cuts
from gridledger.sources.kept import kept

DROPPED_DETAIL = 25


def row_key(section: str, identity: list[str]) -> Column:
    """SHA-256 of the section and the identity values; null differs from any text."""
    values = F.array(*[F.col(c).cast("string") for c in identity])
    return F.sha2(F.to_json(F.struct(F.col(section).cast("string").alias("section"), values.alias("values"))), 256)


def row_hash(values: list[str]) -> Column:
    """SHA-256 of the values as JSON; null differs from any text and keeps its place."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in values])), 256)


def dedupe_first(rows: DataFrame, by: list[str], key: str, order: str, measures: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of each key stays; dropped rows name the measures that disagree with it.

    All drops are there; `detail` marks the first few of each file that a report shows in full. `order` is
    unique within a key (of rows that share the first place, one stays). First rows are found by partial minima, and
    all rows meet those of their key, one row each, by a join that Spark can split; so a key of a third of all rows is
    neither sorted nor gathered."""
    first = rows.groupBy(*by, key).agg(F.min(F.struct(F.col(order).alias("at"), F.struct(*measures).alias("kept"))).alias("_first"))
    each = rows.join(first, [*by, key])
    names = [c for c in rows.columns if c not in (*by, key)]
    kept_rows = rows.groupBy(*by, key).agg(F.min_by(F.struct(*names), order).alias("_k")).select(*by, key, "_k.*").select(*rows.columns)
    dropped = each.filter(F.col(order) != F.col("_first.at")).select(*rows.columns, F.col("_first.at").alias("kept_row"), F.col("_first.kept").alias("_kept"))
    differs = F.array_compact(F.array(*[F.when(~F.col(m).eqNullSafe(F.col(f"_kept.{m}")), F.lit(m)) for m in measures]))
    dropped = kept(dropped.withColumn("conflicts", differs).drop("_kept"))
    # where a file's details end: its first drops are ranked, which tasks cut before they meet
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    ends = dropped.select(*by, order).withColumn("_n", place).filter(F.col("_n") <= DROPPED_DETAIL).groupBy(*by).agg(F.max(order).alias("_end"))
    dropped = dropped.join(ends, by)
    return kept_rows, dropped.withColumn("detail", F.col(order) <= F.col("_end")).drop("_end")


def fingerprint(rows: DataFrame, by: list[str], order: str, values: list[str], columns: DataFrame | None = None) -> DataFrame:
    """by..., fingerprint, n_rows: depends on every value and its column, on the places of rows, and on the columns.

    columns: by..., pos, key, label, type. A row's digest is the SHA-256 of its place and values as JSON, nulls
    included, so a value that moves to the next column shows. A file's is that of its columns and of the sums
    of the eight words of its rows' digests: any number of rows, constant memory, and equal rows don't cancel."""
    row = F.sha2(F.to_json(F.struct(F.col(order).cast("string").alias("at"), F.array(*[F.col(c).cast("string") for c in values]).alias("values")), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"_w{k}") for k in range(8)]
    out = rows.select(*by, row.alias("_h")).groupBy(*by).agg(*words, F.count("*").alias("n_rows"))
    names = F.lit("")
    if columns is not None:
        told = columns.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "key", "label", "type")))).alias("_columns"))  # columns of one file
        out, names = out.join(told, by, "left"), F.coalesce("_columns", F.lit(""))
    return out.select(*by, F.sha2(F.concat_ws("|", names, F.col("n_rows"), *[f"_w{k}" for k in range(8)]), 256).alias("fingerprint"), "n_rows")


def diff_rows(before: DataFrame, after: DataFrame, by: list[str], key: str, values: list[str]) -> DataFrame:
    """by..., key, change: added, changed or removed; unchanged rows are left out."""
    names = [*by, key]
    a = before.select(*names, row_hash(values).alias("_a"))
    b = after.select(*names, row_hash(values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, names, "full_outer").select(*names, change.alias("change")).filter(F.col("change").isNotNull())


def diff_counts(before: DataFrame, after: DataFrame, by: list[str], key: str, values: list[str], comparable: DataFrame | None = None) -> DataFrame:
    """by..., added, changed, removed. Files that are absent from `comparable` (by..., same_identity) compare as far as both exist."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    out = diff_rows(before, after, by, key, values).groupBy(*by).agg(n("added"), n("changed"), n("removed"))
    if comparable is None:
        return out
    known = out.join(comparable, by, "left").withColumn("_ok", F.coalesce("same_identity", F.lit(True)))
    return known.select(*by, *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in ("added", "changed", "removed")])


def match_layers(manifest: DataFrame, layers: DataFrame) -> DataFrame:
    """manifest (stem, folder) with the layer of its stem, else of its folder; unmatched rows stay, with null.

    layers: layer, name, short, order. Slugs match with or without a trailing test, tests or testing."""
    names = F.explode(F.array_distinct(F.array_compact(F.array("layer", "name", "short")))).alias("name")
    alias = layers.select("layer", "order", names).select("layer", "order", F.explode(F.array(T.slug("name"), T.plain_slug("name"))).alias("alias")).filter("alias <> ''")
    alias = alias.groupBy("alias").agg(F.min_by("layer", F.struct("order", "layer")).alias("layer"))
    out, found = manifest, []
    for k, wanted in enumerate((T.slug("stem"), T.plain_slug("stem"), T.slug("folder"), T.plain_slug("folder"))):
        out = out.withColumn(f"_s{k}", wanted).join(alias.select(F.col("alias").alias(f"_s{k}"), F.col("layer").alias(f"_l{k}")), f"_s{k}", "left")
        found.append(f"_l{k}")
    return out.withColumn("layer", F.coalesce(*found)).drop(*found, *[f"_s{k}" for k in range(4)])


def current_snapshots(snapshots: DataFrame, series: list[str]) -> DataFrame:
    """The snapshot of highest sequence of each series, with the number of its snapshots."""
    names = [c for c in snapshots.columns if c not in series]
    a = snapshots.groupBy(*series).agg(F.max_by(F.struct(*names), "sequence").alias("_s"), F.count("*").alias("snapshots"))
    return a.select(*series, "_s.*", "snapshots")


def changed_files(manifest: DataFrame, current: DataFrame, series: list[str]) -> DataFrame:
    """manifest with `changed`: no current snapshot, or another file hash."""
    known = current.select(*series, F.col("file_hash").alias("_known"))
    return manifest.join(known, series, "left").withColumn("changed", ~F.col("file_hash").eqNullSafe(F.col("_known"))).drop("_known")


def changed_by_layer(changed: DataFrame, current: DataFrame, layers: DataFrame) -> DataFrame:
    """layer, files, changed_files, is_changed, last_loaded and last_file of every layer, and a row with layer null for
    files of no layer. changed: what changed_files gives; current: layer, file, created_at."""
    zero = F.lit(0).cast("long")
    of = changed.groupBy("layer").agg(F.count("*").alias("files"), F.count_if("changed").alias("changed_files"))
    last = current.groupBy("layer").agg(F.max("created_at").alias("last_loaded"), F.max_by("file", "created_at").alias("last_file"))
    known = layers.select("layer").join(of.filter("layer IS NOT NULL"), "layer", "left").join(last, "layer", "left")
    known = known.select("layer", F.coalesce("files", zero).alias("files"), F.coalesce("changed_files", zero).alias("changed_files"), "last_loaded", "last_file")
    other = of.filter("layer IS NULL").select("layer", "files", zero.alias("changed_files"))
    return known.unionByName(other, allowMissingColumns=True).withColumn("is_changed", F.col("changed_files") > 0)


def detect_renames(new: DataFrame, current: DataFrame, present: DataFrame) -> DataFrame:
    """layer, file, old_file where exactly one absent file of the layer had the new file's content.

    Absent files are counted for each content first, so copies of one content are never paired."""
    fresh = new.join(current.select("layer", "file"), ["layer", "file"], "left_anti").filter(F.col("content_hash") != "")
    gone = current.join(present.select("layer", "file"), ["layer", "file"], "left_anti")
    gone = gone.groupBy("layer", "content_hash").agg(F.count("*").alias("_n"), F.min("file").alias("old_file")).filter("_n = 1")
    return fresh.join(gone, ["layer", "content_hash"]).select("layer", "file", "old_file")


def identical_files(current: DataFrame, layer: list[str], content: str, name: str, shown: int = 10) -> DataFrame:
    """Contents that several current files of a layer share: n_files and the first names.

    Names are ranked, not collected, so a content that a third of all files share is no burden."""
    n = current.groupBy(*layer, content).agg(F.count("*").alias("n_files")).filter("n_files > 1")
    w = Window.partitionBy(*layer, content).orderBy(name)
    first = current.join(n.drop("n_files"), [*layer, content], "left_semi").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= shown)
    listed = first.groupBy(*layer, content).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(name).cast("string").alias("f")))), lambda x: x["f"]), ",").alias("files"))
    return n.join(listed, [*layer, content])


def only_changed(loads: DataFrame, current: DataFrame, series: list[str]) -> DataFrame:
    """Loads whose content differs from their file's latest."""
    known = current.select(*series, F.col("content_hash").alias("_known"))
    return loads.join(known, series, "left").filter(~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known")


def next_sequence(loads: DataFrame, snapshots: DataFrame, series: list[str]) -> DataFrame:
    """Loads with the sequence after their file's highest, 1 for a new file."""
    last = snapshots.groupBy(*series).agg(F.max("sequence").alias("_last"))
    return loads.join(last, series, "left").withColumn("sequence", F.coalesce(F.col("_last"), F.lit(0)) + 1).drop("_last")


def latest_per_layer(current: DataFrame, layer: list[str]) -> DataFrame:
    """The current snapshot of the most recently loaded file of each layer."""
    names = [c for c in current.columns if c not in layer]
    return current.groupBy(*layer).agg(F.max_by(F.struct(*names), F.struct("created_at", "snapshot_id")).alias("_s")).select(*layer, "_s.*")


def resolve_snapshot(snapshots: DataFrame, layer: list[str], file: str = "file", year: int | None = None, month: int | None = None, snapshot_id=None, name=None, every_file: bool = False) -> DataFrame:
    """The snapshot of each layer that a read is about, with is_current.

    One named by its id wins. Else the file decides, the most recently loaded one of a layer if none is named,
    and of its snapshots that of highest sequence, within one month if that is given: the period must equal it.
    every_file: all files of a layer instead of one."""
    current = current_snapshots(snapshots, [*layer, file])
    newest = current.select(*layer, file, F.col("snapshot_id").alias("_newest"))
    if snapshot_id is not None:
        found = snapshots.filter(F.col("snapshot_id") == F.lit(snapshot_id))
    else:
        found = snapshots
        if name is not None:
            found = found.filter(F.col(file) == F.lit(name))
        elif not every_file:
            found = found.join(latest_per_layer(current, layer).select(*layer, file), [*layer, file], "left_semi")
        if year is not None and month is not None:
            found = found.filter((F.col("period.year") == year) & (F.col("period.month") == month))
        found = current_snapshots(found, [*layer, file]).drop("snapshots")
    return found.join(newest, [*layer, file]).withColumn("is_current", F.col("snapshot_id") == F.col("_newest")).drop("_newest")


def history(snapshots: DataFrame, series: list[str], span: int | None = None) -> DataFrame:
    """snapshots with is_current (newest of its file) and age_rank (1 is the newest).

    span: series are cut into ranges of so many seconds, for those of very many snapshots."""
    order = [F.col("created_at").desc(), F.col("sequence").desc()]
    if span is None:
        out = snapshots.withColumn("age_rank", F.row_number().over(Window.partitionBy(*series).orderBy(*order)))
    else:
        out = cuts.numbered(snapshots, series, -F.unix_micros(F.col("created_at").cast("timestamp_ltz")) / 1_000_000, order, "age_rank", span)
    return out.withColumn("is_current", F.col("age_rank") == 1)


def layer_rollup(snapshots: DataFrame, layers: DataFrame, layer: str, file: str) -> DataFrame:
    """Files, snapshots, current records, latest load with its period, and files by time of each layer; layers
    without data stay, with zeros. snapshots: period, created_at, row_count, sequence."""
    current = current_snapshots(snapshots, [layer, file])
    newest_first = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp_ltz"))).alias("t"), F.col(file).cast("string").alias("f"))))  # files of one layer
    a = current.groupBy(layer).agg(
        F.count("*").alias("files"), F.sum("snapshots").alias("n_snapshots"), F.sum("row_count").alias("records"), F.max("created_at").alias("latest"),
        F.max_by("period", F.struct("created_at", file)).alias("latest_period"), F.transform(newest_first, lambda x: x["f"]).alias("sources"))
    zero = F.lit(0).cast("long")
    sources = F.coalesce("sources", F.array().cast("array<string>")).alias("sources")
    return layers.join(a, layer, "left").select(*layers.columns, *[F.coalesce(c, zero).alias(c) for c in ("files", "n_snapshots", "records")], "latest", "latest_period", sources)


def layer_test_counts(cells: DataFrame, columns: DataFrame, current: DataFrame, layer: str) -> DataFrame:
    """layer, test_count: the sum of each file's only test-count column; null if a file has none or several."""
    marked = columns.filter(F.col("type") == "number").withColumn("measure", T.measure_identity("label", "key")).filter(F.col("measure") == "total_tests")
    per = current.select("snapshot_id", layer).join(marked.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.min("key").alias("key")), "snapshot_id", "left")
    sums = cells.groupBy("snapshot_id", "key").agg(F.sum("n").alias("total")).join(per.filter("n = 1").select("snapshot_id", "key"), ["snapshot_id", "key"]).select("snapshot_id", "total")
    each = per.select("snapshot_id", layer, "n").join(sums, "snapshot_id", "left")
    complete = F.bool_and(F.coalesce(F.col("n"), F.lit(0)) == 1)
    return each.groupBy(layer).agg(F.when(complete, F.coalesce(F.sum("total"), F.lit(0))).alias("test_count"))


def release_rollup(snapshots: DataFrame, releases: DataFrame, series: list[str]) -> DataFrame:
    """releases (app, release, order, is_current) with layers, current records and newest load, and the app's current release."""
    current = current_snapshots(snapshots, series)
    a = current.groupBy("app", "release").agg(F.count_distinct("layer").alias("layers"), F.sum("row_count").alias("records"), F.max("created_at").alias("latest"))
    zero = F.lit(0).cast("long")
    out = releases.join(a, ["app", "release"], "left")
    now = F.max_by("release", F.struct("is_current", "order")).over(Window.partitionBy("app"))
    return out.select("app", "release", "order", F.coalesce("layers", zero).alias("layers"), F.coalesce("records", zero).alias("records"), "latest", now.alias("current_release"))


def backfill_orphans(records: DataFrame, uploads: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one imported snapshot for each scope of rows without snapshot, rows skipped as they name no release)."""
    orphans = records.filter(F.col("snapshot_id").isNull())
    skipped = orphans.filter(F.col("release").isNull()).groupBy(*[c for c in scope if c != "release"]).agg(F.count("*").alias("skipped"))
    rows = orphans.filter(F.col("release").isNotNull()).groupBy(*scope).agg(F.count("*").alias("row_count"))
    up = uploads.groupBy(*scope).agg(F.max_by("file_name", "uploaded_at").alias("file"), F.max("uploaded_at").alias("created_at"), F.sum("total_rows").alias("total_rows"))
    return rows.join(up, scope, "left").withColumn("sequence", F.lit(1)), skipped


def assign_files(snapshots: DataFrame, scope: list[str]) -> DataFrame:
    """Snapshots with a file from their sources (`combined` for several), numbered anew by time within it."""
    paths = F.array_distinct(F.filter("sources", lambda s: s.isNotNull() & (s != "")))
    file = F.coalesce("file", F.when(F.size(paths) > 1, "combined").when(F.size(paths) == 1, F.get(paths, 0)))
    out = snapshots.withColumn("file", file)
    return out.withColumn("sequence", F.row_number().over(Window.partitionBy(*scope, "file").orderBy("created_at", "snapshot_id")))


def uniqueness_faults(records: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for sound records."""
    return records.groupBy(*key).count().filter("count > 1")
