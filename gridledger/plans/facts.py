"""Queries of facts packs and what reports leave out of them: customers' sheets as the files of releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.operators import automation as A
from gridledger.operators import coverage as C
from gridledger.operators import facts as G
from gridledger.operators import quality as Q
from gridledger.plans.coverage import PLACE, REFERENCES, SIDES, features, references, systems
from gridledger.plans.ingest import BOARDS, sheet_parts
from gridledger.plans.quality import FIGURES
from gridledger.plans.registry import query, table
from gridledger.sources.kept import kept

LAYERS = (("run_results", "Run results", 0), ("status", "Status", 1), ("inventory", "Lists", 2), ("volume", "Counts", 3))
RELEASE = "CAST(snapshot_id AS BIGINT) // 4 % 20"
FACTS = BOARDS + f""", sheet AS (SELECT *, {RELEASE} AS release, (['Run results', 'Status', 'Lists', 'Counts'])[k + 1] AS layer FROM per),
layers AS (SELECT release, k, layer, CAST(sum(n_rows) AS BIGINT) AS records FROM sheet GROUP BY ALL),
pairs AS (SELECT * FROM (SELECT release, layer AS upper, records AS high, lag(layer) OVER w AS lower, lag(records) OVER w AS low FROM layers WINDOW w AS (PARTITION BY release ORDER BY k)) WHERE lower IS NOT NULL),
{SIDES.removeprefix("WITH ").rstrip()}, {REFERENCES},
item AS (SELECT coalesce(f_at[1], s_at[1]) // 4 % 20 AS release, key, display, status, f_at[2] AS section FROM entries),
counts AS (SELECT release, count(*) FILTER (status <> 'missing_in_feature') AS n, count(*) FILTER (status <> 'missing_in_system') AS m, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'missing_in_system') AS gaps FROM item GROUP BY release),
trace AS (SELECT *, CASE WHEN n > 0 THEN round(covered * 100.0 / n, 1) ELSE 100 END AS forward_pct, CASE WHEN m > 0 THEN round(covered * 100.0 / m, 1) ELSE 100 END AS backward_pct FROM counts),
ref AS (SELECT *, file // 4 % 20 AS release FROM refs)
"""


def release_of(c: str = "snapshot_id"):
    return F.expr(f"cast({c} AS bigint) div 4 % 20")


def releases(spark: SparkSession, sf_dir: str) -> dict:
    """The tables that facts are made of: files with their boards and warnings, layers, pyramid, coverage and automation of each release."""
    parts = sheet_parts(spark, sf_dir)
    names = spark.createDataFrame(list(LAYERS), "kind string, layer string, `order` int")
    fill = kept(Q.column_fill(parts["cells"], "snapshot_id"))
    warnings = Q.inspect([Q.fill_warnings(fill, parts["columns"], parts["n_rows"], "snapshot_id"), Q.measure_warnings(fill, parts["columns"], "snapshot_id")], "snapshot_id")
    period = F.struct(F.lit(2024).alias("year"), F.expr("cast(cast(snapshot_id AS bigint) % 12 + 1 AS int)").alias("month")).alias("period")
    files = parts["roles"].select("snapshot_id", F.concat(F.lit("sheets/"), "snapshot_id").alias("file"), period, "n_rows", "kind").join(F.broadcast(names), "kind").withColumn("release", release_of())
    layers = kept(files.groupBy("release", "layer", "order").agg(F.sum("n_rows").alias("records")).withColumn("test_count", F.lit(None).cast("long")))
    pyramid = G.pyramid(layers, ["release"], "order", "layer", "records", "test_count")

    f, refs = kept(features(spark, sf_dir)), kept(references(spark, sf_dir).withColumn("release", release_of("file")))
    found = C.compare_sides(C.side_keys(f, PLACE, "row_index"), C.side_keys(systems(spark, sf_dir), PLACE, "row_index"))
    found = kept(found.withColumn("release", release_of("coalesce(feature_at.file, system_at.file)")))
    titles = f.select(F.struct(*PLACE, "row_index").alias("feature_at"), G.title_of(["cell", "notes"]).alias("title"))  # a gap's first row
    entries = kept(found.join(titles, "feature_at", "left").withColumn("title", F.coalesce("title", F.lit(""))))
    unread = f.filter("key IS NULL").groupBy(release_of("file").alias("release")).agg(F.count("*").alias("unresolved"))
    summary = kept(C.coverage_summary(entries, by=("release",)).join(unread, "release", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0).cast("long"))))

    runs = parts["run_results"].groupBy(release_of().alias("release")).agg(F.sum("passed").alias("automated"), F.sum("total").alias("total"))
    runs = runs.withColumns({"coverage_pct": F.round(F.col("automated") / F.col("total") * 100, 1), "unmeasured": F.lit("")})
    band = spark.createDataFrame([(30.0, 85.0)], "low double, high double")
    automation = G.automation_facts(A.coverage_report(runs, band), ["release"])
    return {"files": files, "parts": parts, "warnings": warnings, "layers": layers, "pyramid": pyramid, "automation": automation, "summary": summary, "entries": entries, "references": refs}


# What is read back of a release, its files and its other lists.
HEAD = "period string, layers array<struct<layer string, records bigint>>, pyramid array<struct<verdict string>>, traceability struct<features_planned bigint, forward_pct double>, automation struct<coverage_pct double, position string>"
FILES = "array<struct<file string, period string, rows bigint, dashboard string, run_results struct<passed double>, status struct<passed double>, inventory struct<items double>, warnings array<struct<code string>>>>"
LISTS = "array<struct<id string>>"


@query(FACTS + """, bad AS (SELECT release, count(*) FILTER (high >= low) AS violated FROM pairs GROUP BY release), latest AS (SELECT release, max('2024-' || lpad(CAST(CAST(snapshot_id AS BIGINT) % 12 + 1 AS VARCHAR), 2, '0')) AS period FROM sheet GROUP BY release),
odd AS (SELECT release, count(*) FILTER (inside) AS mismatches, count(*) FILTER (NOT inside) AS outside FROM ref GROUP BY release),
auto AS (SELECT release, round(sum(pass) / sum(tc) * 100, 1) AS coverage_pct FROM sheet WHERE k = 0 GROUP BY release)
SELECT s.release, latest.period, s.layer, l.records, snapshot_id AS file, '2024-' || lpad(CAST(CAST(snapshot_id AS BIGINT) % 12 + 1 AS VARCHAR), 2, '0') AS file_period, s.n_rows AS rows, (['run_results', 'status', 'inventory', 'volume'])[s.k + 1] AS dashboard,
  CASE s.k WHEN 0 THEN pass WHEN 1 THEN s_pass WHEN 2 THEN s.n_rows END::DOUBLE AS figure, CASE WHEN s.k <> 0 THEN '' WHEN fails = 0 THEN 'empty_columns' WHEN fails / s.n_rows < 0.2 THEN 'sparse_columns' ELSE '' END AS warnings, violated, n AS features_planned, forward_pct,
  gaps, coalesce(mismatches, 0) AS mismatches, coalesce(outside, 0) AS outside, coverage_pct, CASE WHEN coverage_pct < 30 THEN 'below' WHEN coverage_pct > 85 THEN 'above' ELSE 'within' END AS position
FROM sheet s JOIN layers l ON s.release = l.release AND s.layer = l.layer JOIN latest ON latest.release = s.release JOIN bad ON bad.release = s.release JOIN trace t ON t.release = s.release LEFT JOIN odd ON odd.release = s.release LEFT JOIN auto ON auto.release = s.release""")
def facts_pack(spark, sf_dir):
    """Every release's facts as JSON, read back: layers, files with the figures of their dashboards and warnings, the
    pyramid, traceability and automation."""
    t, by = releases(spark, sf_dir), ["release"]
    files, lists = G.file_facts(t["files"], t["parts"], t["warnings"]), G.traceability_lists(t["entries"], t["references"], by)
    pack = kept(G.facts_pack(files, t["layers"], by, "layer", t["pyramid"], G.traceability_facts(t["summary"], by), t["automation"], lists))
    n = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.size(F.from_json("facts", LISTS)))), F.lit(0)).cast("long")
    listed = pack.filter("part NOT IN ('release', 'files')").groupBy("release").agg(n("not_in_system").alias("gaps"), n("id_mismatches").alias("mismatches"), n("outside").alias("outside"))
    head = pack.filter("part = 'release'").select("release", F.from_json("facts", HEAD).alias("f")).select(
        "release", F.col("f.period").alias("period"), F.inline("f.layers"), F.size(F.filter("f.pyramid", lambda p: p["verdict"] == "violated")).cast("long").alias("violated"),
        F.col("f.traceability.features_planned").alias("features_planned"), F.col("f.traceability.forward_pct").alias("forward_pct"), F.col("f.automation.coverage_pct").alias("coverage_pct"), F.col("f.automation.position").alias("position"))
    head = head.join(listed, "release", "left").fillna(0, ["gaps", "mismatches", "outside"])  # a row for each layer of the 20 releases
    x = pack.filter("part = 'files'").select("release", "layer", F.explode(F.from_json("facts", FILES)).alias("x")).join(F.broadcast(head), ["release", "layer"])
    return x.select(
        "release", "period", "layer", "records", F.col("x.file").alias("file"), F.col("x.period").alias("file_period"), F.col("x.rows").alias("rows"), F.col("x.dashboard").alias("dashboard"),
        F.coalesce("x.run_results.passed", "x.status.passed", "x.inventory.items").alias("figure"), F.array_join(F.transform(F.coalesce("x.warnings", F.array()), lambda w: w["code"]), ",").alias("warnings"),
        "violated", "features_planned", "forward_pct", "gaps", "mismatches", "outside", "coverage_pct", "position")


@query("""SELECT o_orderpriority AS release, 16::BIGINT AS digits, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AND month(o_orderdate) = 3) > 0 AS stale FROM orders GROUP BY 1""")
def stale_facts(spark, sf_dir):
    """Reports saved before the open orders of March were counted, but for those of low priority: whose facts have changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("release"), F.col("o_orderstatus").alias("layer"), "o_orderdate")

    def pack(rows):
        layers = rows.groupBy("release", "layer").agg(F.count("*").alias("records")).withColumns({"order": F.ascii("layer"), "test_count": F.lit(None).cast("long")})
        files = layers.select("release", "layer", F.struct(F.col("layer").alias("file"), F.lit("").alias("period"), F.col("records").alias("rows")).alias("facts"))
        return G.facts_hash(G.facts_pack(files, layers, ["release"], "layer"), ["release"])

    march = (F.col("layer") == "P") & (F.col("release") != "5-LOW") & (F.month("o_orderdate") == 3)
    both = pack(o.filter(~march)).withColumnRenamed("hash", "saved").join(pack(o), "release", "full_outer")
    return both.select("release", F.length("hash").cast("long").alias("digits"), G.is_stale(F.col("saved"), F.col("hash")).alias("stale"))


@query(FACTS + f""", claims AS (SELECT release, 'Item ' || display || ' is open' AS text FROM item WHERE section = '1-URGENT' UNION ALL SELECT release, 'Coverage is ' || forward_pct || '%' FROM trace WHERE forward_pct < backward_pct
  UNION ALL SELECT release, high || ' rows against ' || low FROM pairs WHERE upper = 'Lists' UNION ALL SELECT release, 'Run sheets hold text' FROM trace WHERE forward_pct < backward_pct),
said AS (SELECT DISTINCT release, unnest({FIGURES.format('text')}) AS figure FROM claims), ids AS (SELECT DISTINCT release, key FROM item WHERE section = '1-URGENT'),
shown AS (SELECT release, forward_pct AS pct, '% of the plan is tested by the system layer' AS words FROM trace UNION ALL SELECT release, backward_pct, '% of the system layer''s entries belong to the plan' FROM trace),
open_pairs AS (SELECT * FROM pairs p WHERE high >= low AND NOT (EXISTS (SELECT 1 FROM said s WHERE s.release = p.release AND figure = CAST(high AS VARCHAR)) AND EXISTS (SELECT 1 FROM said s WHERE s.release = p.release AND figure = CAST(low AS VARCHAR)))),
left_out AS (SELECT release, status, display, row_number() OVER (PARTITION BY release, status ORDER BY CAST(substr(key, 3) AS BIGINT)) - 1 AS spot FROM item i WHERE status <> 'covered' AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.release = i.release AND ids.key = i.key)),
gap_lines AS (SELECT release, count(*) || CASE status WHEN 'missing_in_system' THEN ' in the plan but untested (' ELSE ' tested but in no plan (' END || string_agg(display, ', ' ORDER BY spot) || ')' AS label FROM left_out GROUP BY release, status, spot // 100)
SELECT release, 'pyramid' AS kind, 'Inverted layers: ' || upper || ' (' || format('{{:,}}', high) || ' rows) against ' || lower || ' (' || format('{{:,}}', low) || ')' AS label FROM open_pairs
UNION ALL SELECT release, 'percentage', CASE WHEN pct = floor(pct) THEN CAST(CAST(pct AS BIGINT) AS VARCHAR) ELSE CAST(pct AS VARCHAR) END || words FROM shown t WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.release = t.release AND CAST(figure AS DOUBLE) = pct)
UNION ALL SELECT release, 'gap', label FROM gap_lines
UNION ALL SELECT DISTINCT release, 'mismatch', 'Id mismatch: ' || display || ' names ' || token FROM ref r WHERE inside AND NOT (EXISTS (SELECT 1 FROM ids WHERE ids.release = r.release AND ids.key = r.key) AND EXISTS (SELECT 1 FROM ids WHERE ids.release = r.release AND ids.key = r.canon))
UNION ALL SELECT release, 'warning', 'Run results: text_in_measure' FROM trace WHERE NOT forward_pct < backward_pct""")
def missing_items(spark, sf_dir):
    """What the claims of each release leave out of its facts: pairs, percentages, gaps, mismatches and warnings. Claims
    name the urgent entries and the pairs of lists; where less of the plan is tested than tests are planned, also that rate."""
    t = releases(spark, sf_dir)
    pyramid, entries, summary = kept(t["pyramid"]), t["entries"], t["summary"]
    less = summary.filter("forward_pct < backward_pct")
    whole = lambda c: F.col(c).cast("long").cast("string")
    claims = entries.filter("feature_at.section = '1-URGENT'").select("release", F.concat(F.lit("Item "), "display", F.lit(" is open")).alias("text"))
    claims = claims.unionByName(less.select("release", F.concat(F.lit("Coverage is "), F.col("forward_pct").cast("string"), F.lit("%")).alias("text")))
    claims = claims.unionByName(pyramid.filter("upper = 'Lists'").select("release", F.concat(whole("upper_value"), F.lit(" rows against "), whole("lower_value")).alias("text")))
    claims = claims.unionByName(less.select("release", F.lit("Run sheets hold text").alias("text")))
    warnings = summary.select("release", F.lit("Run results").alias("layer"), F.lit("text_in_measure").alias("code"), F.lit("problem").alias("severity"))
    return G.missing_items(kept(claims), "release", "text", pyramid, summary, entries, t["references"], warnings).select("release", "kind", "label")
