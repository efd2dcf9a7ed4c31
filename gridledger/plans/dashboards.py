"""Dashboard queries: line items, orders and events as sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import coverage as C
from gridledger.operators import dashboards as D
from gridledger.plans.registry import query, table
from gridledger.sources.kept import kept

MONEY = "decimal(18,2)"


@query("""SELECT l_returnflag AS section, CAST(CASE WHEN grouping(l_returnflag) = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_total, count(*) AS n_rows,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def section_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("price"))
    return D.section_totals(rows, "section", ["quantity", "price"]).withColumns({c: F.col(c).cast("double") for c in ("quantity", "price")})


@query("""SELECT l_returnflag, CAST(rank AS INTEGER) AS rank, label, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank, l_linestatus || ' · ' || l_returnflag AS label FROM lineitem) WHERE rank <= 10""")
def top_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return D.top_rows(rows, "l_extendedprice", D.row_label(["l_linestatus", "l_returnflag"], "l_returnflag"), ["l_orderkey", "l_linenumber"], ("l_returnflag",))


@query("""SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_orderpriority AS label, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_rows_overall(spark, sf_dir):
    return D.top_rows(table(spark, sf_dir, "orders"), "o_totalprice", D.row_label(["o_orderpriority"], "o_orderstatus"), ["o_orderkey"])


COLUMNS = "snapshot_id string, pos int, key string, label string, type string"


def two_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items and orders as two files whose counts have different labels."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"), F.col("l_linestatus").alias("state"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("row_index"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("cases"))
    cells = D.cells_of(li, F.lit("a"), "section", "row_index", ["state"], ["qty", "price"]).unionByName(D.cells_of(o, F.lit("b"), "section", "row_index", ["priority"], ["cases"]))
    columns = spark.createDataFrame([("a", 0, "state", "State", "string"), ("a", 1, "qty", "Test Count", "number"), ("a", 2, "price", "Price", "number"), ("b", 0, "priority", "Priority", "string"), ("b", 1, "cases", "Total Test Cases", "number")], COLUMNS)
    return cells, columns, spark.createDataFrame([("a", "x"), ("b", "x")], "snapshot_id string, layer string")


@query("""SELECT section, measure, CAST(sum(v) AS DOUBLE) AS total, measure = 'total_tests' AS is_shared FROM (
  SELECT l_returnflag AS section, 'total_tests' AS measure, CAST(l_quantity AS DECIMAL(18,2)) AS v FROM lineitem UNION ALL
  SELECT l_returnflag, 'price', CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem UNION ALL SELECT o_orderstatus, 'total_tests', CAST(o_totalprice AS DECIMAL(18,2)) FROM orders) GROUP BY section, measure""")
def merged_dashboard(spark, sf_dir):
    """Sums of decimals, so that they are exact."""
    cells, columns, current = two_files(spark, sf_dir)
    out = D.merged_dashboard(cells.withColumn("n", F.col("n").cast(MONEY)), columns, current)
    return out.withColumn("total", F.col("total").cast("double"))


@query("""SELECT 'a' AS snapshot_id, l_returnflag AS section, measure, CAST(sum(v) AS DOUBLE) AS total FROM (
  SELECT l_returnflag, 'qty' AS measure, CAST(l_quantity AS DECIMAL(18,2)) AS v FROM lineitem UNION ALL SELECT l_returnflag, 'price', CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem) GROUP BY ALL""")
def single_dashboard(spark, sf_dir):
    """A layer of one file answers as that file: its columns keep their names."""
    cells, columns, current = two_files(spark, sf_dir)
    out = D.merged_dashboard(cells.withColumn("n", F.col("n").cast(MONEY)), columns, current.filter("snapshot_id = 'a'"))
    return out.select(F.lit("a").alias("snapshot_id"), "section", "measure", F.col("total").cast("double").alias("total"))


@query("""WITH v AS (SELECT 'a' AS snapshot_id, l_returnflag AS section, l_orderkey * 10 + l_linenumber AS row_index, l_quantity AS value, l_linestatus AS label FROM lineitem UNION ALL SELECT 'b', o_orderstatus, o_orderkey, o_totalprice, o_orderpriority FROM orders)
SELECT *, 'total_tests' AS measure, CAST(row_number() OVER (ORDER BY value DESC, snapshot_id, section, row_index) AS INTEGER) AS rank FROM v ORDER BY value DESC, snapshot_id, section, row_index LIMIT 10""")
def merged_top_rows(spark, sf_dir):
    """The largest rows of both files by the measure that they share, whatever each calls it."""
    cells, columns, current = two_files(spark, sf_dir)
    return D.merged_top_rows(cells, columns, current.withColumn("created_at", F.col("snapshot_id")))


def order_sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as a sheet with a status word: rows, cells, columns."""
    word = F.when(F.col("o_orderstatus") == "F", "Passed.").when(F.col("o_orderstatus") == "O", "Failed").otherwise("in  progress")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("FL-"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("priority"), word.alias("state"), F.col("o_totalprice").cast(MONEY).alias("cost"), F.lit("all").alias("section"))
    columns = spark.createDataFrame([("o", 0, "id", "ID", "string"), ("o", 1, "priority", "Priority", "string"), ("o", 2, "state", "Status", "string"), ("o", 3, "cost", "Test Cases", "number")], COLUMNS)
    return o, D.cells_of(o, F.lit("o"), "section", "o_orderkey", ["id", "priority", "state"], ["cost"]), columns


ORDER_SHEET = """WITH o AS (SELECT o_orderkey, 'FL-' || o_orderkey AS id, o_orderpriority AS priority, CASE o_orderstatus WHEN 'F' THEN 'Passed.' WHEN 'O' THEN 'Failed' ELSE 'in  progress' END AS state, CAST(o_totalprice AS DECIMAL(18,2)) AS cost FROM orders),
vals AS (SELECT 'id' AS key, id AS v FROM o UNION ALL SELECT 'priority', priority FROM o UNION ALL SELECT 'state', state FROM o),
per AS (SELECT key, v, count(*) AS n FROM vals GROUP BY key, v)
"""


@query(ORDER_SHEET + """SELECT 'o' AS snapshot_id, key, count(*) AS "distinct", CAST(sum(n) AS BIGINT) AS filled, array_to_string(list_sort(list(v))[1:25], '|') AS "values" FROM per GROUP BY key""")
def column_stats(spark, sf_dir):
    _, cells, columns = order_sheet(spark, sf_dir)
    return D.column_stats(cells, columns).drop("outcomes", "identifiers").withColumn("values", F.array_join("values", "|"))


def n_rows_of(rows: DataFrame, snapshot: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows")).withColumn("snapshot_id", F.lit(snapshot))


@query(ORDER_SHEET + """SELECT 'o' AS snapshot_id, key, n AS "distinct", CAST(row_number() OVER (ORDER BY n DESC, key) AS INTEGER) AS rank FROM (SELECT key, count(*) AS n FROM per GROUP BY key) WHERE n BETWEEN 2 AND 12""")
def rank_dimensions(spark, sf_dir):
    o, cells, columns = order_sheet(spark, sf_dir)
    return D.rank_dimensions(columns, D.column_stats(cells, columns), n_rows_of(o, "o"))


@query("SELECT 'o' AS snapshot_id, 'status' AS kind, 'cost' AS measure, 'state' AS status, 'id' AS id_column, 'state' AS dimension, 'id,priority,state' AS labels FROM (SELECT count(*) AS n FROM orders) WHERE n > 12")
def classify_sheet(spark, sf_dir):
    o, cells, columns = order_sheet(spark, sf_dir)
    stats, n = kept(D.column_stats(cells, columns)), n_rows_of(o, "o")
    dims = kept(D.rank_dimensions(columns, stats, n))
    out = D.classify(columns, stats, n).drop("reason").join(D.primary_measure(columns), "snapshot_id").join(D.detect_status_column(columns, stats, n), "snapshot_id").join(D.detect_inventory(columns, stats), "snapshot_id")
    return out.join(D.choose_dimension(dims, "state"), "snapshot_id").join(D.label_columns(columns, dims, cells).select("snapshot_id", F.array_join("labels", ",").alias("labels")), "snapshot_id")


@query(ORDER_SHEET + "SELECT state AS value, count(*) AS n_rows, CAST(sum(cost) AS DOUBLE) AS measure FROM o GROUP BY state")
def status_breakdown(spark, sf_dir):
    return D.status_breakdown(order_sheet(spark, sf_dir)[0], "state", "cost")


@query(ORDER_SHEET + """, b AS (SELECT state, count(*) AS n, CAST(sum(cost) AS DOUBLE) AS m FROM o GROUP BY state)
SELECT coalesce(sum(m) FILTER (state = 'Passed.'), 0) AS passed, coalesce(sum(m) FILTER (state = 'Failed'), 0) AS failed, coalesce(sum(m) FILTER (state = 'in  progress'), 0) AS pending, 0.0::DOUBLE AS unrecognised,
  round(sum(m), 2) AS total, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(state, ',' ORDER BY m DESC) AS statuses, round(coalesce(sum(m) FILTER (state <> 'in  progress'), 0), 2) AS decided,
  round(sum(m) FILTER (state = 'Passed.') / sum(m) FILTER (state <> 'in  progress') * 100, 1) AS pass_rate_pct FROM b""")
def status_summary(spark, sf_dir):
    out = D.status_summary(D.status_breakdown(order_sheet(spark, sf_dir)[0], "state", "cost"))
    return out.withColumns({c: F.round(c, 2) for c in ("total", "decided")})


@query(ORDER_SHEET + """SELECT id || ' · ' || priority AS label, state AS status, CASE state WHEN 'Failed' THEN 'failing' ELSE 'pending' END AS kind FROM o WHERE state <> 'Passed.' ORDER BY o_orderkey LIMIT 20""")
def open_rows(spark, sf_dir):
    o = order_sheet(spark, sf_dir)[0]
    return D.open_rows(o, "state", D.row_label(["id", "priority"], "section"), ["o_orderkey"])


RUNS = """WITH runs AS (SELECT user_id, 'bucket ' || (user_id % 7) AS os, count(*) FILTER (event_type = 'purchase') AS pass, count(*) FILTER (event_type = 'error') AS fail,
  count(*) FILTER (event_type = 'signup') AS na, count(*) FILTER (event_type IN ('purchase', 'error', 'signup')) AS cases FROM events GROUP BY user_id)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda *k: F.count_if(F.col("event_type").isin(*k))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(n("purchase").alias("pass"), n("error").alias("fail"), n("signup").alias("na"), n("purchase", "error", "signup").alias("cases"))
    return e.withColumn("os", F.concat(F.lit("bucket "), F.col("user_id") % 7))


@query(RUNS + """SELECT sum(pass)::DOUBLE AS passed, sum(fail)::DOUBLE AS failed, sum(na)::DOUBLE AS not_run, sum(cases)::DOUBLE AS total, sum(pass + fail)::DOUBLE AS executed, round(sum(cases - pass - fail - na)::DOUBLE, 2) AS unaccounted,
  round(sum(pass) / sum(pass + fail) * 100, 1) AS pass_rate_pct, round(sum(pass + fail) / sum(cases) * 100, 1) AS executed_pct, true AS reconciles FROM runs""")
def run_summary(spark, sf_dir):
    return D.run_summary(runs(spark, sf_dir), "pass", "fail", "na", "cases")


@query(RUNS + """SELECT value, n_rows, pass, fail, CAST(row_number() OVER (ORDER BY n_rows DESC, value) AS INTEGER) AS rank, round(pass / (pass + fail) * 100, 1) AS pass_rate FROM (
  SELECT os AS value, count(*) AS n_rows, sum(pass)::DOUBLE AS pass, sum(fail)::DOUBLE AS fail FROM runs GROUP BY os)""")
def dimension_breakdown(spark, sf_dir):
    return D.dimension_breakdown(runs(spark, sf_dir), "os", ["pass", "fail"]).withColumn("pass_rate", D.bucket_rate("pass", "fail"))


@query(RUNS + "SELECT os AS label, pass, fail, cases FROM runs WHERE fail > 0 ORDER BY fail DESC, user_id LIMIT 10")
def failing_rows(spark, sf_dir):
    return D.failing_rows(runs(spark, sf_dir), "fail", D.row_label(["os"], "os"), ["user_id"], ["pass", "fail", "cases"])


@query("""WITH f AS (SELECT o_orderkey, o_custkey, o_orderkey % 17 <> 0 AS readable FROM orders), n AS (SELECT count(*) FILTER (readable) AS items, count(*) FILTER (NOT readable) AS unreadable, count(*) FILTER (readable AND o_orderkey % 3 = 0) AS linked FROM f)
SELECT items, unreadable, items AS duplicates, 'FL' AS family, 'CS' AS link_family, linked, items - linked AS unlinked, linked AS links, round(linked / items * 100, 1) AS linked_pct FROM n""")
def inventory_summary(spark, sf_dir):
    """Every order twice, every third with a link to its customer."""
    return D.inventory_summary(inventory(spark, sf_dir), ["cell", "notes"], "cell", "row_index")


@query("""SELECT * FROM (SELECT 'linked' AS kind, 'FL-' || o_orderkey AS display, 1::BIGINT AS links FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 ORDER BY display LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'unlinked', 'FL-' || o_orderkey, 0::BIGINT FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 20)""")
def inventory_lists(spark, sf_dir):
    return D.inventory_lists(inventory(spark, sf_dir), ["cell", "notes"], "cell", "row_index", "CS")


def inventory(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cell = F.when(F.col("o_orderkey") % 17 == 0, "to be named").otherwise(F.concat(F.lit("FL-"), F.col("o_orderkey")))
    rows = o.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "o_orderkey", cell.alias("cell"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("CS-"), F.col("o_custkey"), F.lit(" since Sep 26"))).otherwise("no link").alias("notes"))
    return rows.filter("o_orderkey % 17 <> 0 OR copy = 0").withColumn("row_index", F.col("o_orderkey") * 2 + F.col("copy"))


@query("""WITH f AS (SELECT * FROM part WHERE contains(lower(p_type), 's') OR contains(lower(p_name), 's') OR contains(lower(p_brand), 's'))
SELECT p_partkey, p_brand, p_name, p_type, p_size, (SELECT count(*) FROM f) AS n_total FROM f ORDER BY p_brand, p_partkey LIMIT 50 OFFSET 50""")
def search_records(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    return D.search_records(rows, "S", "p_brand", ["p_name", "p_type"], ["p_size"], ["p_brand", "p_partkey"], page=2, size=50)


@query("""WITH f AS (SELECT page_id, url FROM pages WHERE contains(lower(url), 'e.com/en/') OR page_id = TRY_CAST('e.com/en/' AS BIGINT)) SELECT page_id, url, (SELECT count(*) FROM f) AS n_total FROM f ORDER BY page_id LIMIT 100 OFFSET 20""")
def indexed_search(spark, sf_dir):
    """Pages whose address holds a text, by postings of its runs of three letters: the second page of twenty and what follows."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("pages").alias("section"))
    postings = kept(D.search_postings(rows, ["section", "url"], "page_id"))
    how = {"section": "section", "texts": ["url"], "numbers": ["page_id"], "order": ["page_id"], "size": 20}
    pages = [D.search_indexed(rows, postings, "E.com/EN/", "page_id", page=p, **how) for p in range(2, 7)]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.select("page_id", "url", "n_total")


@query("""SELECT o_orderstatus AS word, CASE o_orderstatus WHEN 'F' THEN 'passing' WHEN 'O' THEN 'failing' WHEN 'P' THEN 'pending' ELSE '' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def outcomes(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "  Verified! ").when(F.col("o_orderstatus") == "O", "Not   OK:").when(F.col("o_orderstatus") == "P", "N/A")
    o = table(spark, sf_dir, "orders").withColumn("kind", T.outcome_of(word))
    return o.groupBy(F.col("o_orderstatus").alias("word"), "kind").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, lower(regexp_replace(c_name, '[\\s\\-_#]+', '', 'g')) AS key, 'CUSTOMER' AS family FROM customer""")
def read_identifiers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("cell", F.regexp_replace("c_name", "#", " "))
    return C.with_identifier(c, "cell").select("c_mktsegment", F.coalesce("key", T.canonical("cell")).alias("key"), F.coalesce(F.nullif("family", F.lit("")), T.family_of("cell")).alias("family"))
