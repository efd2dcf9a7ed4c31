"""Automation queries: return flags are layers, the months of shipping are releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.operators import automation as A
from gridledger.operators import dashboards as D
from gridledger.operators import facts as G
from gridledger.plans.registry import query, table

LAYERS = """WITH li AS (SELECT l_returnflag AS layer, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS release, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END AS automated, CAST(l_quantity AS BIGINT) AS qty FROM lineitem),
sums AS (SELECT layer, release, NOT (layer = 'R' AND release % 3 = 0) AS has, CASE WHEN layer = 'N' AND release % 3 = 1 THEN 0 ELSE coalesce(sum(automated), 0) END::DOUBLE AS a, CASE WHEN layer = 'A' THEN count(*) ELSE sum(qty) END::DOUBLE AS t FROM li GROUP BY layer, release),
layers AS (SELECT layer, release, has AND t > 0 AS measured, CASE WHEN NOT has THEN 'none of the layer''s sheets counts automated tests' WHEN t <= 0 THEN 'nothing to take a share of: all totals are 0' ELSE '' END AS reason,
  CASE WHEN has THEN a ELSE 0 END AS automated, CASE WHEN has THEN t ELSE 0 END AS total, CASE WHEN has AND t > 0 THEN round(a / t * 100, 1) END AS coverage_pct, CASE WHEN NOT has THEN '' WHEN layer = 'A' THEN 'row_count' ELSE 'test_count' END AS basis FROM sums),
releases AS (SELECT release, coalesce(sum(automated) FILTER (measured), 0) AS automated, coalesce(sum(total) FILTER (measured), 0) AS total, coalesce(string_agg(layer, ',' ORDER BY layer) FILTER (NOT measured), '') AS unmeasured,
  CASE WHEN count(DISTINCT basis) FILTER (measured) > 1 THEN 'mixed' ELSE coalesce(max(basis) FILTER (measured), '') END AS basis, CASE WHEN sum(total) FILTER (measured) > 0 THEN round(sum(automated) FILTER (measured) / sum(total) FILTER (measured) * 100, 1) END AS coverage_pct FROM layers GROUP BY release)
"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag's line items of a month as a layer of a release. Layer A has no column of totals, R at times none of
    automated counts, and N at times a blank one."""
    li = table(spark, sf_dir, "lineitem")
    release = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("release")
    rows = li.select(F.col("l_returnflag").alias("layer"), release, F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long")).alias("auto"), F.col("l_quantity").cast("long").alias("qty")).withColumn("snapshot_id", F.concat_ws("-", "layer", "release"))
    n_rows = rows.groupBy("snapshot_id", "layer", "release").agg(F.count("*").alias("n_rows"))
    blank = (F.col("layer") == "N") & (F.col("release") % 3 == 1)
    cells = rows.select("snapshot_id", F.inline(F.array(F.struct(F.lit("auto").alias("key"), F.when(~blank, F.col("auto").cast("double")).alias("n")), F.struct(F.lit("qty").alias("key"), F.col("qty").cast("double").alias("n")))))
    column = lambda when, pos, key, label: F.when(when, F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit("number").alias("type")))
    has = ~((F.col("layer") == "R") & (F.col("release") % 3 == 0))
    columns = n_rows.select("snapshot_id", F.inline(F.array_compact(F.array(column(has, 0, "auto", "Auto Test Count"), column(F.col("layer") != "A", 1, "qty", "Total")))))
    return A.measure_layers(cells, A.detect_automation_columns(columns), n_rows, ["layer", "release"])


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.release_coverage(layers(spark, sf_dir), ["release"], "layer")


@query(LAYERS + "SELECT * FROM layers")
def layer_measures(spark, sf_dir):
    return layers(spark, sf_dir)


@query(LAYERS + "SELECT * FROM releases")
def release_coverage(spark, sf_dir):
    return releases(spark, sf_dir)


@query(LAYERS + """SELECT *, 30.0::DOUBLE AS band_low, 55.5::DOUBLE AS band_high, CASE WHEN coverage_pct IS NULL THEN 'unmeasured' WHEN coverage_pct < 30 THEN 'below' WHEN coverage_pct > 55.5 THEN 'above' ELSE 'within' END AS position,
  CASE WHEN coverage_pct < 30 THEN round_even(30 - coverage_pct, 0) WHEN coverage_pct > 55.5 THEN round_even(coverage_pct - 55.5, 0) WHEN coverage_pct IS NOT NULL THEN 0.0 END AS points FROM releases""")
def coverage_report(spark, sf_dir):
    band = spark.createDataFrame([("survey a", 30.0, 40.0), ("survey b", 35.0, 55.5)], "source string, low double, high double")
    return A.coverage_report(releases(spark, sf_dir), band)


@query(LAYERS + """, p AS (SELECT *, last_value(coverage_pct IGNORE NULLS) OVER w AS before, last_value(CASE WHEN coverage_pct IS NOT NULL THEN release END IGNORE NULLS) OVER w AS before_name FROM releases WINDOW w AS (ORDER BY release ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT release, coverage_pct, round(coverage_pct - before, 1) AS delta, CASE WHEN coverage_pct IS NOT NULL AND before IS NOT NULL THEN before_name END AS compared_to FROM p""")
def automation_trend(spark, sf_dir):
    r = releases(spark, sf_dir).withColumn("app", F.lit("all"))
    return A.automation_trend(r, ["app"], "release", "release").select("release", "coverage_pct", "delta", "compared_to")


COLUMNS = """WITH c AS (SELECT p_brand || '/' || p_partkey % 50 AS snapshot_id, p_partkey AS pos, 'c' || p_partkey AS key, {labels}[p_size % {n} + 1] AS label, p_partkey % 4 <> 0 AS is_number FROM part)
"""
AUTOMATION_LABELS = ["Automated Test Count", "Test Count", "Total", "Hours", "Author", "AUTO cases"]
RUN_LABELS = ["Pass", "Failures", "N/A", "TC count", "OS ver.", "Failed total", "Skipped", "Pass %"]


def part_columns(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    """A few parts as the columns of one of many sheets, with one of the labels each."""
    p = table(spark, sf_dir, "part")
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("p_size") % len(labels) + 1).cast("int"))
    return p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey") % 50).alias("snapshot_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("c"), "p_partkey").alias("key"), label.alias("label"), F.when(F.col("p_partkey") % 4 != 0, "number").otherwise("string").alias("type"))


@query(COLUMNS.format(labels=AUTOMATION_LABELS, n=len(AUTOMATION_LABELS)) + """, a AS (SELECT snapshot_id, arg_min(key, pos) AS automated FROM c WHERE is_number AND label IN ('Automated Test Count', 'AUTO cases') GROUP BY 1),
r AS (SELECT c.snapshot_id, arg_min(key, pos) FILTER (label IN ('Automated Test Count', 'Test Count', 'Total')) AS named, count(*) AS n, min(key) AS one_key FROM c LEFT JOIN a USING (snapshot_id) WHERE is_number AND key IS DISTINCT FROM automated GROUP BY 1)
SELECT snapshot_id, automated, coalesce(named, CASE WHEN n = 1 THEN one_key END) AS total FROM (SELECT DISTINCT snapshot_id FROM c) LEFT JOIN a USING (snapshot_id) LEFT JOIN r USING (snapshot_id)""")
def automation_columns(spark, sf_dir):
    return A.detect_automation_columns(part_columns(spark, sf_dir, AUTOMATION_LABELS))


@query(COLUMNS.format(labels=RUN_LABELS, n=len(RUN_LABELS)) + """, p AS (SELECT snapshot_id, arg_min(key, pos) AS passed FROM c WHERE is_number AND label IN ('Pass', 'Pass %') GROUP BY 1),
f AS (SELECT snapshot_id, arg_min(key, pos) AS failed FROM c WHERE is_number AND label IN ('Failures', 'Failed total') GROUP BY 1), n AS (SELECT snapshot_id, arg_min(key, pos) AS not_run FROM c WHERE is_number AND label IN ('N/A', 'Skipped') GROUP BY 1),
t AS (SELECT c.snapshot_id, arg_min(key, pos) AS total FROM c LEFT JOIN f USING (snapshot_id) WHERE is_number AND label IN ('TC count', 'Failed total') AND key IS DISTINCT FROM failed GROUP BY 1)
SELECT snapshot_id, passed, failed, not_run, total, passed IS NOT NULL AND (failed IS NOT NULL OR total IS NOT NULL) AS is_run FROM (SELECT DISTINCT snapshot_id FROM c) LEFT JOIN p USING (snapshot_id) LEFT JOIN f USING (snapshot_id) LEFT JOIN n USING (snapshot_id) LEFT JOIN t USING (snapshot_id)""")
def run_columns(spark, sf_dir):
    """Roles of the columns of many sheets; one column can have one role only."""
    return D.detect_run_columns(part_columns(spark, sf_dir, RUN_LABELS))


@query("""WITH t AS (SELECT o_custkey % 50 AS release, 0 AS ord, 'open' AS name, count(*) FILTER (o_orderstatus = 'O') AS n, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END) AS BIGINT) AS tests FROM orders GROUP BY 1
UNION ALL SELECT o_custkey % 50, 1, 'partial', count(*) FILTER (o_orderstatus = 'P'), NULL FROM orders GROUP BY 1 UNION ALL SELECT o_custkey % 50, 2, 'final', count(*) FILTER (o_orderstatus = 'F'), CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END) AS BIGINT) FROM orders GROUP BY 1),
p AS (SELECT release, name AS upper, n, lag(name) OVER w AS lower, lag(n) OVER w AS ln FROM t WINDOW w AS (PARTITION BY release ORDER BY ord))
SELECT release, lower, upper, 'rows' AS unit, ln::DOUBLE AS lower_value, n::DOUBLE AS upper_value, CASE WHEN ln = 0 OR n = 0 THEN 'not checked' WHEN n >= ln THEN 'violated' ELSE 'holds' END AS verdict FROM p WHERE lower IS NOT NULL""")
def pyramid(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    a = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("release")).agg(n("O").alias("o"), n("P").alias("p"), n("F").alias("f"))
    layer = lambda at, name, count, tests: F.struct(F.lit(at).alias("ord"), F.lit(name).alias("name"), F.col(count).alias("n"), tests.cast("long").alias("tests"))
    a = a.select("release", F.array(layer(0, "open", "o", F.col("o") * 2), layer(1, "partial", "p", F.lit(None)), layer(2, "final", "f", F.col("f") * 3)).alias("l"))
    return G.pyramid(a.select("release", F.inline("l")), ["release"], "ord", "name", "n", "tests")
