"""Coverage queries: orders as the feature side, line items as the system side.

A sheet is a customer's orders or a supplier's items. Some orders have no items and some orders' cells name
no id, so there are gaps in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import coverage as C
from gridledger.plans.registry import query, table
from gridledger.sources import files as X
from gridledger.sources.kept import kept

F_SQL = """feature AS (
  SELECT o_custkey AS file, o_orderpriority AS section, o_orderkey AS row_index,
    CASE WHEN o_orderkey % 17 = 0 THEN 'to be named' ELSE 'FL-' || o_orderkey || ' - ' || o_orderpriority END AS cell,
    lower('FL' || o_orderkey) AS k, 'FL-' || o_orderkey AS display, o_orderkey % 17 <> 0 AS readable,
    CASE WHEN o_orderkey % 50 = 1 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS other,
    'see CS-' || o_custkey || CASE WHEN o_orderkey % 50 = 1 THEN coalesce(' and FL-' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '') ELSE '' END AS notes
  FROM orders)"""
REFERENCES = """many AS (SELECT file, count(*) AS rows_, count(*) FILTER (readable) AS carrying FROM feature GROUP BY file),
named AS (SELECT f.file, row_index, k AS key, display, 'fl' || other AS canon, 'FL-' || other AS token, notes AS snippet, other % 17 <> 0 AS inside
  FROM feature f WHERE readable AND other IS NOT NULL),
found AS (SELECT file, count(*) AS findings FROM named GROUP BY file),
refs AS (SELECT named.* FROM named JOIN many USING (file) JOIN found USING (file) WHERE carrying >= 0.5 * rows_ AND findings <= 0.5 * rows_)"""
# Word characters of other scripts as ten letters: too long for a token, so that none begins, ends or goes on there.
TOKENS_SQL = r"""WITH tokens AS (SELECT doc_id, source, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]|[^\x00-\x7F\P{N}]', 'xxxxxxxxxx', 'g'), '\b([A-Za-z][A-Za-z0-9]{0,7})[-_ ]?(\d+)\b') AS found FROM documents)"""
S_SQL = """system AS (
  SELECT l_suppkey AS file, l_returnflag AS section, l_orderkey * 10 + l_linenumber AS row_index, lower('fl' || l_orderkey) AS k, 'fl ' || l_orderkey AS display
  FROM lineitem)"""
SIDES = f"""WITH {F_SQL}, {S_SQL},
fb AS (SELECT *, k IS DISTINCT FROM lag(CASE WHEN readable THEN k END) OVER (PARTITION BY file, section ORDER BY row_index) AS starts FROM feature),
sb AS (SELECT *, k IS DISTINCT FROM lag(k) OVER (PARTITION BY file, section ORDER BY row_index) AS starts FROM system),
fk AS (SELECT k, arg_min(display, (file, section, row_index)) AS display, min((file, section, row_index)) AS at, count(*) AS n, count(*) FILTER (starts) AS blocks FROM fb WHERE readable GROUP BY k),
sk AS (SELECT k, arg_min(display, (file, section, row_index)) AS display, min((file, section, row_index)) AS at, count(*) AS n, count(*) FILTER (starts) AS blocks FROM sb GROUP BY k),
entries AS (
  SELECT coalesce(fk.k, sk.k) AS key, CASE WHEN fk.k IS NULL THEN 'missing_in_feature' WHEN sk.k IS NULL THEN 'missing_in_system' ELSE 'covered' END AS status,
    coalesce(fk.display, sk.display) AS display, coalesce(fk.n, 0) AS feature_rows, coalesce(sk.n, 0) AS system_rows,
    coalesce(fk.blocks, 0) AS feature_count, coalesce(sk.blocks, 0) AS system_count, coalesce(fk.blocks, 0) > 1 OR coalesce(sk.blocks, 0) > 1 AS duplicate, fk.at AS f_at, sk.at AS s_at
  FROM fk FULL JOIN sk ON fk.k = sk.k)
"""
PLACE = ["file", "section"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf_dir, "orders").withColumn("other", F.when(F.col("o_orderkey") % 50 == 1, before))
    cell = F.when(F.col("o_orderkey") % 17 == 0, "to be named").otherwise(F.concat(F.lit("FL-"), F.col("o_orderkey"), F.lit(" - "), "o_orderpriority"))
    notes = F.concat(F.lit("see CS-"), F.col("o_custkey"), F.coalesce(F.concat(F.lit(" and FL-"), F.col("other").cast("string")), F.lit("")))
    rows = o.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("row_index"), cell.alias("cell"), notes.alias("notes"))
    return C.with_identifier(rows, "cell")


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"), F.concat(F.lit("fl "), F.col("l_orderkey")).alias("cell"))
    return C.with_identifier(rows, "cell")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_sides(C.side_keys(features(spark, sf_dir), PLACE, "row_index"), C.side_keys(systems(spark, sf_dir), PLACE, "row_index"))


@query(SIDES + """, fam AS (SELECT upper(regexp_extract(display, '^[A-Za-z]+')) AS family FROM feature WHERE readable GROUP BY 1 ORDER BY count(*) DESC LIMIT 1)
SELECT count(*) FILTER (status <> 'missing_in_feature') AS feature_total, count(*) FILTER (status <> 'missing_in_system') AS system_total,
  count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'missing_in_system') AS missing_in_system,
  count(*) FILTER (status = 'missing_in_feature') AS missing_in_feature, count(*) FILTER (duplicate) AS duplicates,
  (SELECT count(*) FROM feature WHERE NOT readable) AS unresolved, (SELECT family FROM fam) AS family, (SELECT max(split_part(notes, '-', 1)[5:]) FROM feature) AS related_family,
  round(count(*) FILTER (status = 'covered') * 100.0 / count(*) FILTER (status <> 'missing_in_feature'), 1) AS forward_pct,
  round(count(*) FILTER (status = 'covered') * 100.0 / count(*) FILTER (status <> 'missing_in_system'), 1) AS backward_pct FROM entries""")
def coverage_summary(spark, sf_dir):
    """Coverage of orders by line items; each side is read once and kept."""
    f, s = kept(features(spark, sf_dir)), kept(systems(spark, sf_dir))
    found = C.compare_sides(C.side_keys(f, PLACE, "row_index"), C.side_keys(s, PLACE, "row_index"))
    unread = C.unresolved_entries(f, "feature", "cell", "row_index").unionByName(C.unresolved_entries(s, "system", "cell", "row_index"))
    family = kept(C.dominant_family(f, PLACE, "row_index"))
    related = C.supporting_family(kept(C.related_ids(f, ["cell", "notes"], "cell", family, "row_index")))
    return C.coverage_summary(found, unread, family, C.dominant_family(s, PLACE, "row_index"), related)


@query(SIDES + """SELECT key, status, display, feature_rows, system_rows, feature_count, system_count, duplicate, f_at[1] AS feature_file, f_at[2] AS feature_section, f_at[3] AS feature_row, s_at[1] AS system_file, s_at[2] AS system_section, s_at[3] AS system_row FROM entries""")
def coverage_entries(spark, sf_dir):
    first = [F.col(f"{side}_at.{c}").alias(f"{side}_{name}") for side in ("feature", "system") for c, name in (("file", "file"), ("section", "section"), ("row_index", "row"))]
    return entries(spark, sf_dir).select("key", "status", "display", "feature_rows", "system_rows", "feature_count", "system_count", "duplicate", *first)


@query(SIDES + """SELECT key, status, CASE status WHEN 'missing_in_system' THEN 0 WHEN 'missing_in_feature' THEN 1 ELSE 2 END AS status_rank,
  'fl|' || lpad(CAST(length(key) - 2 AS VARCHAR), 10, '0') || substr(key, 3) AS sort_key FROM entries""")
def coverage_order(spark, sf_dir):
    return C.order_entries(entries(spark, sf_dir)).select("key", "status", "status_rank", F.array_join("natural_key", "|").alias("sort_key"))


@query(SIDES + """, first AS (SELECT e.*, f.cell AS f_cell, f.notes FROM entries e LEFT JOIN feature f ON f.file = f_at[1] AND f.section = f_at[2] AND f.row_index = f_at[3])
SELECT row_number() OVER (ORDER BY CASE status WHEN 'missing_in_system' THEN 0 WHEN 'missing_in_feature' THEN 1 ELSE 2 END, CAST(substr(key, 3) AS BIGINT)) AS row_no, display AS id, status, CASE WHEN duplicate THEN 'yes' ELSE '' END AS duplicate, feature_count, system_count, coalesce(CAST(f_at[1] AS VARCHAR), '') AS feature_file, coalesce(f_at[2], '') AS feature_section,
  coalesce(CAST(s_at[1] AS VARCHAR), '') AS system_file, coalesce(s_at[2], '') AS system_section, CASE WHEN f_at IS NULL THEN '' ELSE 'CS-' || f_at[1] END AS related,
  CASE WHEN f_at IS NULL THEN '' ELSE 'cell=' || f_cell || '; notes=' || notes END AS feature_details, CASE WHEN s_at IS NULL THEN '' ELSE 'cell=fl ' || s_at[3] // 10 END AS system_details FROM first""")
def coverage_csv(spark, sf_dir):
    """The whole matrix as a CSV file has it: first rows with their details, related ids, and each row's place."""
    f, s = kept(features(spark, sf_dir)), kept(systems(spark, sf_dir))
    found = kept(C.compare_sides(C.side_keys(f, PLACE, "row_index"), C.side_keys(s, PLACE, "row_index")))
    related = C.supporting_family(kept(C.related_ids(f, ["cell", "notes"], "cell", C.dominant_family(f, PLACE, "row_index"), "row_index")))
    at = [*PLACE, "row_index"]
    first = lambda rows, side: rows.join(found.select(f"{side}_at.*"), at, "left_semi")  # only the rows that are shown
    cells = lambda rows, names: rows.select(*at, F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("key"), F.col(c).alias("s")) for i, c in enumerate(names)])))
    order = ["status_rank", "natural_key"]
    rows = C.csv_rows(C.order_entries(found), related, C.row_details(cells(first(f, "feature"), ["cell", "notes"]), at), C.row_details(cells(first(s, "system"), ["cell"]), at), tuple(order))
    return X.numbered(rows, order).drop(*order)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ev' || user_id % 3 END AS key FROM events), b AS (SELECT *, key IS DISTINCT FROM lag(key) OVER (ORDER BY event_id) AS starts FROM e)
SELECT key, count(*) AS n_rows, count(*) FILTER (starts) AS blocks, min(event_id) AS first_row FROM b WHERE key IS NOT NULL GROUP BY key""")
def long_blocks(spark, sf_dir):
    """All events as one section, errors without an id: runs of one key over the boundaries of ranges."""
    cell = F.when(F.col("event_type") != "error", F.concat(F.lit("EV-"), F.col("user_id") % 3)).otherwise("none")
    rows = table(spark, sf_dir, "events").select(F.lit("f").alias("file"), F.lit("all").alias("section"), F.col("event_id").alias("row_index"), cell.alias("cell"))
    keys = C.side_keys(C.with_identifier(rows, "cell"), PLACE, "row_index", span=1 << 10)
    return keys.select("key", "n_rows", F.col("blocks").cast("long").alias("blocks"), F.col("first_at.row_index").alias("first_row"))


@query(f"""WITH {F_SQL} SELECT 'feature' AS side, 'unresolved' AS status, cell AS display, row_index FROM feature WHERE NOT readable""")
def coverage_unresolved(spark, sf_dir):
    return C.unresolved_entries(features(spark, sf_dir), "feature", "cell", "row_index")


PARTS = """WITH p AS (SELECT p_brand AS brand, p_partkey AS k, CASE WHEN p_size % 3 = 0 OR p_brand LIKE '%1' THEN '' WHEN p_size % 3 = 1 THEN 'AB' ELSE 'CD' END AS family, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM part),
n AS (SELECT brand, half, family, count(*) AS n, min(k) AS first_k FROM p GROUP BY ALL),
sides AS (SELECT brand, half, arg_min(family, (-n, first_k)) AS family, round(coalesce(sum(n) FILTER (family = ''), 0) / sum(n), 3) AS numeric_ratio, CAST(sum(n) AS BIGINT) AS occurrences FROM n GROUP BY brand, half)
"""


def part_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's parts as two sides, even and odd keys; their ids have one of two families or none."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    cell = F.when((F.col("p_size") % 3 == 0) | F.col("p_brand").endswith("1"), key).when(F.col("p_size") % 3 == 1, F.concat(F.lit("AB-"), key)).otherwise(F.concat(F.lit("cd "), key, F.lit(": part")))
    rows = p.select(F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("half"), F.col("p_partkey").alias("row_index"), cell.alias("cell"))
    return C.describe_sides(C.with_identifier(rows, "cell"), ["brand"], "row_index", ("brand", "half"))


@query(PARTS + "SELECT * FROM sides")
def coverage_sides(spark, sf_dir):
    return part_sides(spark, sf_dir)


@query(PARTS + """, b AS (SELECT f.brand, f.family AS ff, s.family AS sf, f.numeric_ratio AS fr, s.numeric_ratio AS sr FROM sides f JOIN sides s ON f.brand = s.brand AND f.half = 'even' AND s.half = 'odd')
SELECT brand, 'family_mismatch' AS code, '' AS side FROM b WHERE ff <> '' AND sf <> '' AND ff <> sf UNION ALL SELECT brand, 'numeric_key_column', 'feature' FROM b WHERE fr >= 0.9 UNION ALL SELECT brand, 'numeric_key_column', 'system' FROM b WHERE sr >= 0.9""")
def coverage_warnings(spark, sf_dir):
    sides = kept(part_sides(spark, sf_dir))
    half = lambda x: sides.filter(F.col("half") == x).drop("half")
    return C.coverage_warnings(half("even"), half("odd"), ("brand",))


@query(f"""WITH {F_SQL}
SELECT k AS key, 'cs' || file AS canon, 'CS-' || file AS token, 'CS' AS token_family, notes AS cell, 1 AS place FROM feature WHERE readable""")
def coverage_related(spark, sf_dir):
    rows = features(spark, sf_dir)
    family = C.dominant_family(rows, PLACE, "row_index")
    return C.supporting_family(kept(C.related_ids(rows, ["cell", "notes"], "cell", family, "row_index")))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.id_references(kept(features(spark, sf_dir)), ["cell", "notes"], "cell", "file", "row_index")  # read four times


@query(f"WITH {F_SQL}, {REFERENCES} SELECT * FROM refs")
def id_references(spark, sf_dir):
    return references(spark, sf_dir)


@query(f"""WITH {F_SQL}, d AS (SELECT DISTINCT ON (file, k) file, k, display, row_index FROM feature WHERE readable ORDER BY file, k, row_index),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_index) AS rk FROM d),
s AS (SELECT file, string_agg(display, ',' ORDER BY rk) FILTER (rk <= 20) AS first_ids, count(*) AS distinct_ids FROM r GROUP BY file)
SELECT f.file, coalesce(any_value(first_ids), '') AS first_ids, coalesce(any_value(distinct_ids), 0) AS distinct_ids, count(*) FILTER (readable) AS matched, count(*) FILTER (NOT readable) AS unresolved, count(*) AS total
FROM feature f LEFT JOIN s ON f.file = s.file GROUP BY f.file""")
def describe_side(spark, sf_dir):
    return C.describe_side(features(spark, sf_dir), "file", "row_index")


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS ids FROM orders GROUP BY 1)
SELECT c_name AS layer, CASE WHEN n IS NULL THEN 'layer_missing' WHEN n = 0 THEN 'no_data' ELSE 'no_ids' END AS problem FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE n IS NULL OR n = 0 OR ids = 0""")
def structural_problems(spark, sf_dir):
    """Customers as layers: some have no orders, some no finished ones, and only dear ones are named by an id."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").withColumn("cell", F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("FL-"), "o_orderkey")).otherwise("no number"))
    done = F.col("o_orderstatus") == "F"
    per = C.with_identifier(o, "cell").groupBy("o_custkey").agg(F.count_if(done).alias("n_rows"), F.count(F.when(done, F.col("key"))).alias("ids"))
    sides = per.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("layer"), F.lit(True).alias("present"), "n_rows", "ids")
    return C.structural_problems(c.select(F.col("c_name").alias("layer")), sides)


@query(SIDES + """SELECT file, CASE WHEN file % 3 = 0 THEN 'notes' ELSE 'cell' END AS id_column, row_index, CASE WHEN file % 3 = 0 THEN 'cs' || file WHEN readable THEN k END AS key, CASE WHEN file % 3 = 0 THEN 'CS' WHEN readable THEN 'FL' END AS family FROM feature""")
def side_rows(spark, sf_dir):
    """Every file's identifiers by its own first column; a third of the files have their columns the other way round."""
    f = features(spark, sf_dir)
    turned = F.col("file") % 3 == 0
    at = lambda a, b: F.when(turned, a).otherwise(b)
    cells = f.select(F.col("file").alias("snapshot_id"), "section", "row_index", F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("s")) for c in ("cell", "notes")])))
    columns = f.select(F.col("file").alias("snapshot_id"), F.inline(F.array(F.struct(at(1, 0).alias("pos"), F.lit("cell").alias("key")), F.struct(at(0, 1).alias("pos"), F.lit("notes").alias("key"))))).distinct()
    return C.side_rows(cells, columns, override="no such column").select(F.col("snapshot_id").alias("file"), "id_column", "row_index", "key", "family")


@query("""SELECT DISTINCT 'fl' || (n_nationkey * 1000003) AS key, 'area FL-' || (n_nationkey * 1000003) AS section, 'FL-' || (n_nationkey * 1000003) AS display
FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE 'fl' || (n_nationkey * 1000003) NOT IN (SELECT 'fl' || o_orderkey FROM orders WHERE o_orderkey % 17 <> 0)""")
def section_ids(spark, sf_dir):
    """Customers' nations as section titles that name an id."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("area FL-"), F.col("c_nationkey").cast("long") * 1000003).alias("section"))
    f = features(spark, sf_dir)
    return C.section_ids(rows, "section", C.dominant_family(f, PLACE, "row_index"), f.filter("key IS NOT NULL").select("key").distinct())


@query(TOKENS_SQL + r"""SELECT upper(regexp_extract(t, '^[A-Za-z]+')) AS family, count(*) AS n, count(DISTINCT lower(regexp_replace(t, '[\s\-_]+', '', 'g'))) AS n_keys FROM (SELECT unnest(found) AS t FROM tokens) GROUP BY 1""")
def document_tokens(spark, sf_dir):
    """Identifier families in all documents."""
    t = table(spark, sf_dir, "documents").select(F.explode(T.tokens("text")).alias("t"))
    return t.groupBy(T.family_of("t").alias("family")).agg(F.count("*").alias("n"), F.count_distinct(T.canonical("t")).alias("n_keys"))
