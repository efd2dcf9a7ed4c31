"""Snapshot queries: two versions of orders, events as loads, pages and documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import coverage as C
from gridledger.operators import snapshots as S
from gridledger.plans.dashboards import two_files
from gridledger.plans.registry import query, table
from gridledger.sources import files as X
from gridledger.sources import stored as Y
from gridledger.sources.kept import new_folder

VERSIONS = """WITH bounds AS (SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders),
v1 AS (SELECT o_custkey AS file, o_orderkey, o_totalprice AS price, o_orderdate < last AS here FROM orders, bounds),
v2 AS (SELECT o_custkey AS file, o_orderkey, CASE WHEN month(o_orderdate) = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderdate > first AS here FROM orders, bounds),
d AS (SELECT v1.file, v1.o_orderkey, CASE WHEN NOT v1.here THEN 'added' WHEN NOT v2.here THEN 'removed' WHEN v1.price <> v2.price THEN 'changed' END AS change FROM v1 JOIN v2 USING (o_orderkey))
"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they stood before the last day, and as they stand after the first one; those of a July have a new price."""
    o = table(spark, sf_dir, "orders")
    days = o.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    both = o.crossJoin(F.broadcast(days))  # one row
    file, price = F.col("o_custkey").alias("file"), F.col("o_totalprice")
    v1 = both.filter("o_orderdate < last").select(file, "o_orderkey", price.alias("price"))
    v2 = both.filter("o_orderdate > first").select(file, "o_orderkey", F.when(F.month("o_orderdate") == 7, price + 1).otherwise(price).alias("price"))
    return v1, v2


@query(VERSIONS + "SELECT file, o_orderkey, change FROM d WHERE change IS NOT NULL")
def diff_rows(spark, sf_dir):
    return S.diff_rows(*versions(spark, sf_dir), ["file"], "o_orderkey", ["price"])


@query(VERSIONS + """SELECT file, CASE WHEN file % 5 <> 0 THEN count(*) FILTER (change = 'added') END AS added, CASE WHEN file % 5 <> 0 THEN count(*) FILTER (change = 'changed') END AS changed,
  CASE WHEN file % 5 <> 0 THEN count(*) FILTER (change = 'removed') END AS removed FROM d WHERE change IS NOT NULL GROUP BY file""")
def diff_counts(spark, sf_dir):
    """Files whose number is a multiple of 5 had other identity columns before."""
    v1, v2 = versions(spark, sf_dir)
    same = v1.select("file").union(v2.select("file")).distinct().withColumn("same_identity", F.col("file") % 5 != 0)
    return S.diff_counts(v1, v2, ["file"], "o_orderkey", ["price"], same)


@query("""SELECT o_custkey AS file, count(*) AS n_rows, o_custkey % 5 <> 4 AND o_custkey % 5 <> 3 AND count(*) FILTER (o_custkey % 5 = 1 AND o_orderstatus = 'P') = 0 AND count(*) FILTER (o_custkey % 5 = 2 AND o_orderkey % 4 = 0) = 0 AS same FROM orders GROUP BY o_custkey""")
def fingerprints(spark, sf_dir):
    """Whether a customer's sheet reads as before. Of five customers one is the same; in others the state of open orders
    moves to the next column, some prices change, a column has a new label, or the rows are in another order."""
    o = table(spark, sf_dir, "orders")
    case = F.col("o_custkey") % 5
    row = lambda state, spare, price, at: o.select(F.col("o_custkey").alias("file"), at.alias("at"), state.alias("state"), spare.alias("spare"), price.alias("price"))
    status, none, price, key = F.col("o_orderstatus"), F.lit(None).cast("string"), F.col("o_totalprice"), F.col("o_orderkey")
    shifts = (case == 1) & (status == "P")
    v1 = row(status, none, price, key)
    v2 = row(F.when(~shifts, status), F.when(shifts, status), F.when((case == 2) & (key % 4 == 0), price + 0.01).otherwise(price), F.when(case == 4, -key).otherwise(key))
    names = lambda label: o.select(F.col("o_custkey").alias("file")).distinct().select("file", F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("key"), (label if c == "spare" else F.lit(c)).alias("label"), F.lit("string").alias("type")) for i, c in enumerate(("state", "spare", "price"))])))
    of = lambda v, label: S.fingerprint(v, ["file"], "at", ["state", "spare", "price"], names(label))
    before, now = of(v1, F.lit("Spare")), of(v2, F.when(F.col("file") % 5 == 3, "Reserve").otherwise("Spare"))
    return before.join(now.select("file", F.col("fingerprint").alias("now")), "file").select("file", "n_rows", (F.col("fingerprint") == F.col("now")).alias("same"))


@query("""WITH r AS (SELECT *, row_number() OVER w AS n, first_value(l_quantity) OVER w AS kq, first_value(l_tax) OVER w AS kt, first_value(l_linenumber) OVER w AS kept_row FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax))
SELECT l_orderkey, l_linenumber, kept_row, array_to_string(list_filter([CASE WHEN l_quantity <> kq THEN 'l_quantity' END, CASE WHEN l_tax <> kt THEN 'l_tax' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM r WHERE n > 1""")
def dropped_duplicates(spark, sf_dir):
    """Line items of an order with the same flags are one identity."""
    li = table(spark, sf_dir, "lineitem").withColumn("row_key", S.row_key("l_returnflag", ["l_linestatus"]))
    li = li.withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"))
    _, dropped = S.dedupe_first(li, ["l_orderkey"], "row_key", "place", ["l_quantity", "l_tax"])
    return dropped.select("l_orderkey", "l_linenumber", F.col("kept_row.l_linenumber").alias("kept_row"), F.array_join("conflicts", ",").alias("conflicts"))


@query("""SELECT l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL""")
def kept_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("row_key", S.row_key("l_returnflag", ["l_linestatus"]))
    return S.dedupe_first(li, ["l_orderkey"], "row_key", "l_linenumber", ["l_quantity"])[0].select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_faults(spark, sf_dir):
    return S.uniqueness_faults(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


LOADS = """WITH loads AS (SELECT event_id AS snapshot_id, event_type AS layer, user_id AS file, event_id AS sequence, ts AS created_at, CAST(value AS BIGINT) AS row_count, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d FROM events)
"""


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots: a user's events of a type are the versions of one file; days stand for months."""
    e = table(spark, sf_dir, "events")
    whole = F.bround(F.col("value"), 0).cast("long")
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("event_type").alias("layer"), F.col("user_id").alias("file"), F.col("event_id").alias("sequence"), F.col("ts").alias("created_at"), whole.alias("row_count"), F.struct(F.year("ts").alias("year"), F.dayofmonth("ts").alias("month")).alias("period"))


@query(LOADS + "SELECT layer, file, max(sequence) AS sequence, max(snapshot_id) AS snapshot_id, count(*) AS snapshots FROM loads GROUP BY layer, file")
def current_snapshots(spark, sf_dir):
    return S.current_snapshots(loads(spark, sf_dir), ["layer", "file"]).select("layer", "file", "sequence", "snapshot_id", "snapshots")


@query(LOADS + "SELECT layer, arg_max(file, created_at) AS file, arg_max(snapshot_id, created_at) AS snapshot_id FROM loads GROUP BY layer")
def latest_per_layer(spark, sf_dir):
    return S.latest_per_layer(S.current_snapshots(loads(spark, sf_dir), ["layer", "file"]), ["layer"]).select("layer", "file", "snapshot_id")


@query(LOADS + """, cur AS (SELECT layer, file, max(snapshot_id) AS newest FROM loads GROUP BY layer, file), m AS (SELECT layer, file, max(snapshot_id) AS snapshot_id FROM loads WHERE d = 15 GROUP BY layer, file)
SELECT layer, file, snapshot_id, snapshot_id = newest AS is_current FROM m JOIN cur USING (layer, file)""")
def resolve_period(spark, sf_dir):
    """What the 15th means for every file."""
    return S.resolve_snapshot(loads(spark, sf_dir), ["layer"], year=2024, month=15, every_file=True).select("layer", "file", "snapshot_id", "is_current")


@query(LOADS + """, cur AS (SELECT layer, file, max(snapshot_id) AS newest, arg_max(created_at, sequence) AS loaded FROM loads GROUP BY layer, file), one AS (SELECT layer, arg_max(file, (loaded, newest)) AS file FROM cur GROUP BY layer),
named AS (SELECT layer, file, snapshot_id, 'id' AS asked FROM loads WHERE snapshot_id = 7 UNION ALL SELECT layer, file, newest, 'newest' FROM one JOIN cur USING (layer, file)
  UNION ALL SELECT layer, file, newest, 'file' FROM cur WHERE file = 11 UNION ALL SELECT layer, file, max(snapshot_id), 'month' FROM loads JOIN one USING (layer, file) WHERE d = 20 GROUP BY layer, file)
SELECT layer, file, snapshot_id, asked, snapshot_id = newest AS is_current FROM named JOIN cur USING (layer, file)""")
def resolved_snapshots(spark, sf_dir):
    """Snapshots asked for by id, by nothing but the layer, by file, and by month."""
    s = loads(spark, sf_dir)
    ways = {"id": {"snapshot_id": 7}, "newest": {}, "file": {"name": 11}, "month": {"year": 2024, "month": 20}}
    out = None
    for asked, how in ways.items():
        one = S.resolve_snapshot(s, ["layer"], **how).select("layer", "file", "snapshot_id", F.lit(asked).alias("asked"), "is_current")
        out = one if out is None else out.unionByName(one)
    return out


@query(LOADS + "SELECT snapshot_id, layer, file, CAST(row_number() OVER w AS INTEGER) AS age_rank, row_number() OVER w = 1 AS is_current FROM loads WINDOW w AS (PARTITION BY layer, file ORDER BY created_at DESC, sequence DESC)")
def snapshot_history(spark, sf_dir):
    return S.history(loads(spark, sf_dir), ["layer", "file"]).select("snapshot_id", "layer", "file", "age_rank", "is_current")


@query(LOADS + "SELECT snapshot_id, CAST(row_number() OVER w AS INTEGER) AS age_rank, row_number() OVER w = 1 AS is_current FROM loads WINDOW w AS (ORDER BY created_at DESC, sequence DESC)")
def long_history(spark, sf_dir):
    """All loads as the versions of one file, numbered from the newest hour by hour."""
    one = loads(spark, sf_dir).withColumns({"layer": F.lit("all"), "file": F.lit(None).cast("string")})
    return S.history(one, ["layer", "file"], span=3600).select("snapshot_id", "age_rank", "is_current")


@query(LOADS + """, cur AS (SELECT layer, file, arg_max(row_count, sequence) AS row_count, count(*) AS n, arg_max(created_at, sequence) AS latest, arg_max(d, sequence) AS d FROM loads GROUP BY layer, file)
SELECT l AS layer, count(file) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_snapshots, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS records, max(latest) AS latest, CAST(arg_max(d, (latest, file)) AS INTEGER) AS month, coalesce(string_agg(file, ',' ORDER BY latest DESC, CAST(file AS VARCHAR)), '') AS sources
FROM (VALUES ('click'), ('view'), ('purchase'), ('error'), ('signup'), ('nothing')) t(l) LEFT JOIN cur ON cur.layer = l GROUP BY l""")
def layer_rollup(spark, sf_dir):
    layers = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "error", "signup", "nothing")], "layer string")
    out = S.layer_rollup(loads(spark, sf_dir), layers, "layer", "file")
    return out.withColumns({"month": F.col("latest_period.month"), "sources": F.array_join("sources", ",")}).drop("latest_period")


@query(LOADS + """, cur AS (SELECT file % 3 AS app, d % 4 AS release, layer, file, arg_max(row_count, sequence) AS row_count, max(created_at) AS latest FROM loads GROUP BY ALL)
SELECT app, release, release AS "order", count(DISTINCT layer) AS layers, CAST(sum(row_count) AS BIGINT) AS records, max(latest) AS latest, 2 AS current_release FROM cur GROUP BY app, release""")
def release_rollup(spark, sf_dir):
    s = loads(spark, sf_dir).withColumns({"app": F.col("file") % 3, "release": F.col("period.month") % 4})
    rel = s.select("app", "release").distinct().withColumns({"order": F.col("release"), "is_current": F.col("release") == 2})
    return S.release_rollup(s, rel, ["app", "release", "layer", "file"])


@query(LOADS + """, cur AS (SELECT layer, file, max(sequence) AS last FROM loads WHERE d < 20 GROUP BY layer, file)
SELECT n.layer, n.file, coalesce(last, 0) + 1 AS sequence FROM (SELECT DISTINCT layer, file FROM loads) n LEFT JOIN cur USING (layer, file)""")
def next_sequence(spark, sf_dir):
    """The number that each file's load gets after the 20th, by what was loaded before."""
    s = loads(spark, sf_dir)
    return S.next_sequence(s.select("layer", "file").distinct(), s.filter("period.month < 20"), ["layer", "file"])


@query(LOADS + """, cur AS (SELECT layer, file, arg_max(row_count, sequence) AS h FROM loads WHERE d < 20 GROUP BY layer, file), new AS (SELECT layer, file, arg_max(row_count, sequence) AS h FROM loads GROUP BY layer, file)
SELECT new.layer, new.file, new.h AS content_hash, new.h IS DISTINCT FROM cur.h AS changed FROM new LEFT JOIN cur USING (layer, file)""")
def changed_files(spark, sf_dir):
    """Files whose latest content differs from that before the 20th, or which are new since."""
    of = lambda s: S.current_snapshots(s, ["layer", "file"]).select("layer", "file", F.col("row_count").alias("content_hash"), F.col("row_count").alias("file_hash"))
    s = loads(spark, sf_dir)
    before, now = of(s.filter("period.month < 20")), of(s)
    changed = S.only_changed(now.drop("file_hash"), before, ["layer", "file"]).select("layer", "file", F.lit(True).alias("by_content"))
    out = S.changed_files(now, before, ["layer", "file"]).join(changed, ["layer", "file"], "left")
    return out.select("layer", "file", "content_hash", (F.col("changed") & F.coalesce("by_content", F.lit(False))).alias("changed"))


@query(LOADS + """, cur AS (SELECT layer, file, arg_max(row_count, sequence) AS h, arg_max(created_at, sequence) AS loaded FROM loads WHERE d < 20 GROUP BY layer, file), new AS (SELECT layer, file, arg_max(row_count, sequence) AS h FROM loads GROUP BY layer, file),
n AS (SELECT new.layer, count(*) AS files, count(*) FILTER (new.h IS DISTINCT FROM cur.h) AS changed_files FROM new LEFT JOIN cur USING (layer, file) GROUP BY new.layer), l AS (SELECT layer, max(loaded) AS last_loaded, arg_max(file, loaded) AS last_file FROM cur GROUP BY layer)
SELECT layer, files, changed_files, last_loaded, last_file, changed_files > 0 AS is_changed FROM n LEFT JOIN l USING (layer) WHERE layer <> 'error' UNION ALL SELECT 'nothing', 0, 0, NULL, NULL, false UNION ALL SELECT NULL, files, 0, NULL, NULL, false FROM n WHERE layer = 'error'""")
def changed_layers(spark, sf_dir):
    """Files that changed since the 20th, by layer; files of errors match no layer."""
    s = loads(spark, sf_dir)
    before = S.current_snapshots(s.filter("period.month < 20"), ["layer", "file"]).withColumn("file_hash", F.col("row_count"))
    now = S.current_snapshots(s, ["layer", "file"]).select("layer", "file", F.col("row_count").alias("file_hash"))
    changed = S.changed_files(now, before, ["layer", "file"]).withColumn("layer", F.when(F.col("layer") != "error", F.col("layer")))
    layers = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "signup", "nothing")], "layer string")
    return S.changed_by_layer(changed, before, layers)


@query("""WITH cur AS (SELECT source AS layer, doc_id AS file, md5(text) AS h FROM documents), now AS (SELECT layer, CASE WHEN file % 10 = 3 THEN file + 1000000000 ELSE file END AS file, h FROM cur),
fresh AS (SELECT * FROM now WHERE file >= 1000000000 AND h <> ''), gone AS (SELECT layer, h, min(file) AS old_file FROM cur WHERE file % 10 = 3 GROUP BY layer, h HAVING count(*) = 1)
SELECT layer, file, old_file FROM fresh JOIN gone USING (layer, h)""")
def renamed_files(spark, sf_dir):
    """Documents as files, every tenth under a new number."""
    cur = table(spark, sf_dir, "documents").select(F.col("source").alias("layer"), F.col("doc_id").alias("file"), F.md5("text").alias("content_hash"))
    now = cur.withColumn("file", F.when(F.col("file") % 10 == 3, F.col("file") + 1_000_000_000).otherwise(F.col("file")))
    return S.detect_renames(now, cur, now)


@query("""WITH d AS (SELECT source, md5(text) AS content_hash, doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS r FROM documents)
SELECT source, content_hash, count(*) AS n_files, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (r <= 10) AS files FROM d GROUP BY source, content_hash HAVING count(*) > 1""")
def identical_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("content_hash"))
    return S.identical_files(d, ["source"], "content_hash", "doc_id")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS seg FROM pages),
s AS (SELECT *, trim(regexp_replace(lower(seg), '[^a-z0-9]+', '-', 'g'), '-') AS a, trim(regexp_replace(lower(split_part(host, '.', -2)), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM p)
SELECT page_id, CASE WHEN a = 'en' THEN 'english' WHEN a IN ('fr') THEN 'french' WHEN b = 'example' THEN 'sample' END AS layer FROM s""")
def match_layers(spark, sf_dir):
    """Pages as files: the first part of the path is the stem, the domain's name the folder."""
    host, seg = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_extract("url", "^https?://[^/?#]+/([^/?#]*)", 1)
    manifest = table(spark, sf_dir, "pages").select("page_id", seg.alias("stem"), F.element_at(F.split(host, r"\."), -2).alias("folder"))
    layers = spark.createDataFrame([("english", "EN tests", "en", 0), ("french", "FR", None, 1), ("sample", "Example Testing", "sp", 2)], "layer string, name string, short string, `order` int")
    return S.match_layers(manifest, layers).select("page_id", "layer")


@query("""SELECT 'x' AS layer, CAST((SELECT sum(CAST(l_quantity AS DECIMAL(18,2))) FROM lineitem) + (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS DOUBLE) AS test_count""")
def layer_test_counts(spark, sf_dir):
    """Sums of decimals, so that they are exact."""
    cells, columns, current = two_files(spark, sf_dir)
    out = S.layer_test_counts(cells.withColumn("n", F.col("n").cast("decimal(18,2)")), columns, current, "layer")
    return out.withColumn("test_count", F.col("test_count").cast("double"))


@query("""WITH r AS (SELECT o_orderpriority AS app, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS release, o_orderkey FROM orders),
u AS (SELECT o_orderpriority AS app, o_orderstatus AS release, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS file, max(o_orderdate) AS created_at, count(*) AS total_rows FROM orders GROUP BY ALL)
SELECT r.app, r.release, count(*) AS row_count, any_value(u.file) AS file, any_value(u.created_at) AS created_at, any_value(u.total_rows) AS total_rows, 1 AS sequence FROM r JOIN u ON r.app = u.app AND r.release = u.release GROUP BY r.app, r.release""")
def backfill(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    records = o.select(F.lit(None).cast("string").alias("snapshot_id"), F.col("o_orderpriority").alias("app"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("release"))
    uploads = o.select(F.col("o_orderpriority").alias("app"), F.col("o_orderstatus").alias("release"), F.col("o_orderkey").alias("file_name"), F.struct("o_orderdate", "o_orderkey").alias("uploaded_at"), F.lit(1).alias("total_rows"))
    return S.backfill_orphans(records, uploads, ["app", "release"])[0].withColumn("created_at", F.col("created_at.o_orderdate"))


@query("""WITH s AS (SELECT event_id AS snapshot_id, user_id, CASE WHEN event_type = 'view' THEN 'combined' ELSE 'f' || user_id END AS file, ts FROM events)
SELECT snapshot_id, file, CAST(row_number() OVER (PARTITION BY user_id, file ORDER BY ts, snapshot_id) AS INTEGER) AS sequence FROM s""")
def assigned_files(spark, sf_dir):
    f = F.concat(F.lit("f"), F.col("user_id"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("snapshot_id"), "user_id", F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("file"), F.when(F.col("event_type") == "view", F.array(f, F.lit("other"))).otherwise(F.array(F.lit(""), f, f)).alias("sources"))
    return S.assign_files(e, ["user_id"]).select("snapshot_id", "file", "sequence")


@query(LOADS + """SELECT snapshot_id, CASE WHEN file % 4 = 0 THEN file + 5000000 ELSE file END AS file, CASE WHEN snapshot_id % 9 = 0 THEN 12 ELSE d END AS period_month FROM loads WHERE layer <> 'error'""")
def corrected_history(spark, sf_dir):
    """Errors' snapshots deleted, some files renamed, some periods corrected."""
    s = loads(spark, sf_dir)
    left = X.without_snapshots(s, s.filter("layer = 'error'"))
    left = X.move_series(left, s.filter("file % 4 = 0").select("layer", "file", (F.col("file") + 5_000_000).alias("new_file")).distinct())
    fixes = s.filter("snapshot_id % 9 = 0").select("snapshot_id", F.struct(F.col("period.year").alias("year"), F.lit(12).alias("month")).alias("new_period"))
    return X.set_period(left, fixes).select("snapshot_id", "file", F.col("period.month").alias("period_month"))


@query("""WITH s AS (SELECT o_orderstatus AS layer, o_orderpriority AS file, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n_rows, sum(o_orderkey) AS keys, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
  CAST(sum(CAST(o_totalprice + 1 AS DECIMAL(18,2))) AS DOUBLE) AS dearer FROM orders GROUP BY ALL)
SELECT layer, y || ' ' || file AS snapshot_id, CASE WHEN file = '5-LOW' THEN 'LOW' ELSE file END AS file, CASE WHEN y = '1996' THEN 12 ELSE 1 END AS month, n_rows, CAST(keys AS BIGINT) AS keys, CASE WHEN y = '1995' THEN dearer ELSE price END AS price FROM s WHERE NOT (layer = 'F' AND y = '1992')""")
def stored_history(spark, sf_dir):
    """A year's orders of a priority and state are a snapshot. All are stored; those of 1995 are loaded twice again with
    other prices, a file gets a new name, periods of 1996 are corrected and a year is deleted, each of these done twice."""
    o = table(spark, sf_dir, "orders")
    scope = [F.lit("orders").alias("app"), F.lit("r/1").alias("release"), F.col("o_orderstatus").alias("layer")]
    records = o.select(*scope, F.concat_ws(" ", F.year("o_orderdate").cast("string"), "o_orderpriority").alias("snapshot_id"), F.col("o_orderpriority").alias("file"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    snapshots = records.groupBy(*Y.PARTITIONS, "file", "year").agg(F.count("*").alias("row_count")).withColumn("period", F.struct(F.col("year"), F.lit(1).alias("month")))
    rows, root = ("o_orderkey", "o_totalprice"), new_folder(spark, "stored")
    Y.load_snapshots(root, snapshots, records.select(*Y.PARTITIONS, *rows))
    again = lambda t: t.filter("year = 1995")
    fixes = snapshots.filter("year = 1996").withColumn("new_period", F.struct(F.col("year"), F.lit(12).alias("month")))
    renames = snapshots.filter("file = '5-LOW'").select(*Y.SCOPE, "file", F.lit("LOW").alias("new_file")).distinct()
    for _ in range(2):
        Y.load_snapshots(root, again(snapshots), again(records).withColumn("o_totalprice", F.col("o_totalprice") + 1).select(*Y.PARTITIONS, *rows))
        Y.move_files(spark, root, renames)
        Y.correct_periods(spark, root, fixes)
        Y.delete_snapshots(spark, root, snapshots.filter("layer = 'F' AND year = 1992"))
    sums = Y.stored_records(spark, root).groupBy(*Y.PARTITIONS).agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))
    return Y.stored_snapshots(spark, root).join(sums, Y.PARTITIONS).select("layer", "snapshot_id", "file", F.col("period.month").alias("month"), "n_rows", "keys", "price")


@query(r"""WITH p AS (SELECT page_id, octet_length(encode(html)) AS size, 'v' || page_id % 3 AS release, CASE WHEN page_id % 4 = 0 THEN 'notes' || page_id || '.txt' WHEN page_id % 4 = 1 THEN '~$open' || page_id || '.xlsx' WHEN page_id % 4 = 2 THEN 'part' || page_id || '.xlsx' ELSE 'unit/part-' || page_id || '.XLSX' END AS rel FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY release ORDER BY rel) AS n FROM p WHERE page_id % 4 >= 2)
SELECT release, rel AS path, regexp_replace(split_part(rel, '/', -1), '\.[^.]*$', '') AS stem, CASE WHEN contains(rel, '/') THEN 'unit' END AS folder, size, CASE WHEN n > 200 THEN 'too_many_files' WHEN size > 4000 THEN 'file_too_large' END AS error FROM k""")
def file_manifest(spark, sf_dir):
    """Pages as files of a release folder; those after the first 200 of a release are marked, as the feature says."""
    rel = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("notes"), "page_id", F.lit(".txt"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("~$open"), "page_id", F.lit(".xlsx"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("part"), "page_id", F.lit(".xlsx"))).otherwise(F.concat(F.lit("unit/part-"), "page_id", F.lit(".XLSX")))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("file:/data/"), rel).alias("path"), F.current_timestamp().alias("modificationTime"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"), F.concat(F.lit("v"), F.col("page_id") % 3).alias("rel_name"))
    return X.file_manifest(p, F.lit("/data"), F.col("rel_name"), max_bytes=4000).select("release", "path", "stem", "folder", "size", "error")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(regexp_extract('k' || o_orderkey, '\\d+') AS BIGINT)) AS INTEGER) AS place FROM orders""")
def natural_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", T.natural_key(F.concat(F.lit("k"), F.col("o_orderkey"))).alias("k"))
    return o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("k")).alias("place"))


@query(LOADS + """, cur AS (SELECT file, max(snapshot_id) AS snapshot_id FROM loads WHERE layer = 'purchase' GROUP BY file)
SELECT file % 10 AS part, count(*) AS n_rows, CAST(sum(length(props)) AS BIGINT) AS chars FROM cur JOIN events e ON e.event_id = cur.snapshot_id GROUP BY 1""")
def layer_rows(spark, sf_dir):
    """Rows of the purchase layer's current snapshots."""
    current = S.current_snapshots(loads(spark, sf_dir), ["layer", "file"])
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "snapshot_id")
    rows = C.layer_rows(e, current, "purchase")
    return rows.groupBy((F.col("user_id") % 10).alias("part")).agg(F.count("*").alias("n_rows"), F.sum(F.length("props")).cast("long").alias("chars"))
