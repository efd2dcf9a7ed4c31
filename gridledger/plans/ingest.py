"""Ingest queries: documents whose lines are sheet rows with cells parted by bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import boards as B
from gridledger.operators import ingest as I
from gridledger.plans.registry import query, table
from gridledger.sources import files as X
from gridledger.sources.kept import new_folder
from gridledger.streaming import loads as L


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return d.select("file", "row_no", F.split("line", r"\|").alias("cells"))


GRID = r"""WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT file, len(list_filter(string_split(line, '|'), lambda c: trim(regexp_replace(replace(c, chr(160), ' '), '\s+', ' ', 'g')) <> '')) AS width FROM lines)
"""


@query(GRID + """SELECT file, CAST(arg_max(width, (n, width)) AS INTEGER) AS mode_width FROM (SELECT file, width, count(*) AS n FROM w WHERE width >= 2 GROUP BY ALL) GROUP BY file""")
def dominant_widths(spark, sf_dir):
    return I.dominant_width(I.normalise(grid(spark, sf_dir)))


@query()
def loaded_sheets(spark, sf_dir):
    """All steps of ingest over all documents: rows, sections and keys of each file."""
    out = I.load(grid(spark, sf_dir))
    data = out["data"].groupBy("file").agg(F.count("*").alias("n_rows"), F.count_distinct("section").alias("n_sections"), F.count_distinct("row_key").alias("n_keys"))
    cols = out["columns"].groupBy("file").agg(F.count("*").alias("n_columns"), F.count_if(F.col("type") == "number").alias("n_numbers"))
    return cols.join(data, "file", "left").join(out["rejects"], "file", "full_outer").join(out["separators"], "file", "left")


@query()
def sheet_sections(spark, sf_dir):
    out = I.load(grid(spark, sf_dir))
    return I.section_order(out["data"]).join(out["headers"].select("file", "header_row"), "file")


@query("""WITH e AS (SELECT user_id, event_id, event_type AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS b, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS c FROM events),
g AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE a END AS x FROM e), l AS (SELECT *, CASE WHEN x IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 ELSE 3 END AS lead FROM g),
s AS (SELECT *, sum(CASE WHEN lead <= 0 THEN 1 ELSE 0 END) OVER w AS g0, sum(CASE WHEN lead <= 1 THEN 1 ELSE 0 END) OVER w AS g1, sum(CASE WHEN lead <= 2 THEN 1 ELSE 0 END) OVER w AS g2 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN g0 > 0 THEN first_value(x) OVER (PARTITION BY user_id, g0 ORDER BY event_id) END AS x, CASE WHEN g1 > 0 THEN first_value(b) OVER (PARTITION BY user_id, g1 ORDER BY event_id) END AS b,
  CASE WHEN g2 > 0 THEN first_value(c) OVER (PARTITION BY user_id, g2 ORDER BY event_id) END AS c FROM s""")
def forward_fill(spark, sf_dir):
    blank = lambda c, k: F.when(F.col("event_id") % k != 0, F.col(c))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", blank("event_type", 5).alias("x"), blank("event_type", 4).alias("b"), blank("value", 3).alias("c"))
    return I.forward_fill_leading(e, ["x", "b", "c"], ["user_id"], "event_id")


@query("""WITH p AS (SELECT p_brand AS file, count(*) AS n, count(*) FILTER (p_partkey % 5 = 0 OR p_size > 30) AS words FROM part GROUP BY p_brand)
SELECT file, unnest(['p_name', 'p_size', 'p_size_2']) AS key, unnest(['p_name', 'p_size', 'P Size']) AS label, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos,
  unnest(['string', CASE WHEN (n - words) / n >= 0.6 THEN 'number' ELSE 'string' END, 'number']) AS type FROM p""")
def column_types(spark, sf_dir):
    """Brands' parts as sheets: sizes over 30 and some others are words, so that only some brands' sizes are numbers."""
    p = table(spark, sf_dir, "part")
    word = F.when((F.col("p_partkey") % 5 == 0) | (F.col("p_size") > 30), "unknown").otherwise(F.col("p_size").cast("string"))
    data = p.select(F.col("p_brand").alias("file"), F.array(T.norm_cell("p_name"), T.norm_cell(word), T.norm_cell(F.col("p_size").cast("string"))).alias("vals"))
    columns = I.column_keys(p.select(F.col("p_brand").alias("file")).distinct().withColumn("labels", F.array(F.lit("p_name"), F.lit("p_size"), F.lit("P Size"))))
    return I.infer_types(data, columns).select("file", "key", "label", "pos", "type")


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as kept by hand. Every fourth order begins a part, with a title, at times a lone cell after it,
    and the header once more; names are left out where the row above has them; a lone cell continues a row; counts are
    missing. Some sheets have no header, and some hold only prose."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.row_number().over(w.orderBy("o_orderkey")).alias("r"), F.count("*").over(w).alias("n"))
    o = o.withColumn("t", F.floor(F.col("r") / 4)).withColumn("bare", (F.col("o_custkey") % 11 == 1) & (F.col("n") >= 3)).withColumn("prose", F.col("o_custkey") % 11 == 0)
    none, key, at = F.lit(None).cast("string"), F.col("o_orderkey").cast("string"), F.col("r") * 10
    row = lambda when, place, *cells: F.when(when, F.struct(place.cast("long").alias("row_no"), F.array(*cells).alias("cells")))
    first, part, plain = F.col("r") == 1, F.col("r") % 4 == 0, ~F.col("bare") & ~F.col("prose")
    header = [F.lit(" Name"), F.lit("Prio "), F.lit("Test  Count")]
    name = F.when((F.col("r") % 3 == 2), none).otherwise(F.concat(F.lit("order "), key))
    count = F.when((F.col("r") % 7 == 0) & (F.col("r") % 3 != 2), none).otherwise((F.col("o_orderkey") % 100).cast("string"))
    rows = F.array(
        row(plain & first, F.lit(0), F.concat(F.lit("Plan of customer "), F.col("o_custkey")), none, none), row(plain & first, F.lit(1), *header),
        row(plain & part, at, F.concat(F.lit("Part "), F.floor(F.col("t") / 2).cast("string")), none, none),
        row(plain & part & (F.col("t") % 2 == 1), at + 1, none, F.concat(F.lit("tail "), key), none), row(plain & part, at + 2, *header),
        row(plain, at + 3, name, F.col("o_orderpriority"), count), row(plain & (F.col("r") % 5 == 1), at + 4, none, F.concat(F.lit("more "), key), none),
        row(F.col("bare"), at + 3, F.concat(F.lit("FL-"), key), F.concat(F.lit("day "), key), F.col("o_orderpriority")),
        row(F.col("prose"), at + 3, F.concat(F.lit("note "), key), none, none))
    return o.select(F.col("o_custkey").cast("string").alias("file"), F.inline(rows)).filter(F.col("row_no").isNotNull())


ORDER_ROWS = """WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderpriority AS p, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT *, r // 4 AS t, o_custkey % 11 = 1 AND n >= 3 AS bare, o_custkey % 11 = 0 AS prose FROM o),
v AS (SELECT *, lag(k) OVER w AS before, lead(k) OVER w AS after, max(CASE WHEN r = 4 THEN k END) OVER (PARTITION BY o_custkey) AS k4,
  NOT bare AND r % 7 = 0 AND r % 3 <> 2 AS blank FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY r)),
d AS (SELECT CAST(o_custkey AS VARCHAR) AS file, r * 10 + 3 AS row_no, r, t, bare, blank, k,
  CASE WHEN bare THEN 'General' WHEN t = 0 THEN 'Plan of customer ' || o_custkey WHEN t = 1 THEN 'tail ' || k4 ELSE 'Part ' || t // 2 END AS section,
  CASE WHEN bare THEN 'FL-' || k WHEN r % 3 <> 2 THEN 'order ' || k WHEN r % 4 <> 0 THEN 'order ' || before END AS a,
  CASE WHEN bare THEN 'day ' || k ELSE p || CASE WHEN r % 5 = 1 THEN chr(10) || 'more ' || k ELSE '' END
    || CASE WHEN after IS NOT NULL AND (r + 1) % 4 = 0 AND ((r + 1) // 4) % 2 = 1 AND (r + 1) // 4 >= 3 THEN chr(10) || 'tail ' || after ELSE '' END END AS b,
  CASE WHEN bare THEN p WHEN blank THEN NULL ELSE CAST(k % 100 AS VARCHAR) END AS c FROM v WHERE NOT prose)
"""


@query(ORDER_ROWS + "SELECT file, row_no, section, coalesce(a, '~') || '|' || b || '|' || c AS vals FROM d WHERE NOT blank")
def sheet_rows(spark, sf_dir):
    """Every data row of the orders' sheets with its section and values."""
    data = I.load(order_grid(spark, sf_dir))["data"]
    return data.select("file", "row_no", "section", F.array_join(F.transform("vals", lambda v: v["s"]), "|", "~").alias("vals"))


@query(ORDER_ROWS + """, kept AS (SELECT * FROM d WHERE NOT blank), sec AS (SELECT file, section, min(row_no) AS first_row, count(*) AS n FROM kept GROUP BY ALL), s AS (SELECT file, string_agg(section, '/' ORDER BY first_row) AS sections, CAST(sum(n) AS BIGINT) AS n_rows FROM sec GROUP BY file),
f AS (SELECT file, any_value(bare) AS bare, count(*) FILTER (blank) AS separators FROM d GROUP BY file)
SELECT file, CAST(CASE WHEN NOT bare THEN 1 END AS BIGINT) AS header_row, CASE WHEN bare THEN 'column_1,column_2,column_3' ELSE 'name,prio,test_count' END AS keys, CASE WHEN bare THEN 'Column 1,Column 2,Column 3' ELSE 'Name,Prio,Test Count' END AS labels,
  CASE WHEN bare THEN 'string,string,string' ELSE 'string,string,number' END AS types, CASE WHEN bare THEN '0,1,2' ELSE '0,1' END AS identity, separators, sections, n_rows, NULL AS code
FROM f JOIN s USING (file) UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no_header_row' FROM orders WHERE o_custkey % 11 = 0""")
def sheet_summaries(spark, sf_dir):
    """What was read of each of the orders' sheets: header, columns, identity, separators, sections, or why it was rejected."""
    out = I.load(order_grid(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform("cols", lambda x: x[c]), ",").alias(c + "s")
    cols = out["columns"].groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "label", "type"))).alias("cols")).select("file", joined("key"), joined("label"), joined("type"))
    ids = I.identity_columns(out["columns"]).select("file", F.array_join(F.col("identity").cast("array<string>"), ",").alias("identity"))
    n = out["data"].groupBy("file").agg(F.count("*").alias("n_rows"))
    sections = I.section_order(out["data"]).select("file", F.array_join("sections", "/").alias("sections"))
    read = out["headers"].select("file", "header_row")
    for t in (cols, ids, out["separators"], sections, n):
        read = read.join(t, "file")
    return read.unionByName(out["rejects"], allowMissingColumns=True)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS part, o_custkey % 2 = 0 AS tail, left(o_orderpriority, 1) AS p, o_orderpriority, month(o_orderdate) = 1 AS more, o_orderstatus FROM orders),
s AS (SELECT *, coalesce(last_value(CASE WHEN part THEN CASE WHEN tail THEN 'tail ' ELSE 'Part ' END || k END IGNORE NULLS) OVER w, 'General') AS section, count(*) FILTER (part) OVER w AS blk, count(*) FILTER (p <> '5') OVER w AS g,
  nullif(concat_ws(chr(10), CASE WHEN p <> '5' THEN o_orderpriority END, CASE WHEN more THEN 'more ' || k END), '') AS own FROM o WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT k * 8 + 3 AS row_no, section, coalesce(last_value(CASE WHEN p < '4' THEN 'order ' || k END IGNORE NULLS) OVER (PARTITION BY blk ORDER BY k ROWS UNBOUNDED PRECEDING), '~') || '|'
  || coalesce(string_agg(own, chr(10)) OVER (PARTITION BY blk, g ORDER BY k ROWS UNBOUNDED PRECEDING), '~') || '|' || k % 100 || '|' || o_orderstatus AS vals FROM s""")
def long_sheet(spark, sf_dir):
    """All orders as one sheet: parts begin with titles, names and priorities are left out where the row above has them, and
    lone cells continue rows, those of earlier blocks too."""
    o = table(spark, sf_dir, "orders")
    none, key, at, first = F.lit(None).cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderkey") * 8, F.substring("o_orderpriority", 1, 1)
    row = lambda when, place, *cells: F.when(when, F.struct(place.cast("long").alias("row_no"), F.array(*cells).alias("cells")))
    rows = F.array_compact(F.array(
        row(F.col("o_orderstatus") == "P", at + 1, F.concat(F.lit("Part "), key), none, none, none),
        row((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), at + 2, none, F.concat(F.lit("tail "), key), none, none),
        row(F.lit(True), at + 3, F.when(first < "4", F.concat(F.lit("order "), key)), F.when(first != "5", F.col("o_orderpriority")), (F.col("o_orderkey") % 100).cast("string"), F.col("o_orderstatus")),
        row(F.month("o_orderdate") == 1, at + 4, none, F.concat(F.lit("more "), key), none, none)))
    head = o.limit(1).select(F.lit(0).cast("long").alias("row_no"), F.array(*map(F.lit, ("Name", "Prio", "Count", "State"))).alias("cells"))
    sheet = o.select(F.inline(rows)).unionByName(head).withColumn("file", F.lit("orders"))
    data = I.load(sheet.select("file", "row_no", "cells"), most=None)["data"]
    return data.select("row_no", "section", F.array_join(F.transform("vals", lambda v: v["s"]), "|", "~").alias("vals"))


def board_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as sheets of four kinds: run results, statuses, lists of identifiers, and plain counts."""
    o = table(spark, sf_dir, "orders").withColumn("kind", F.col("o_custkey") % 4)
    key, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 50
    text = lambda c: c.cast("string")
    state = F.when(F.col("o_orderstatus") == "F", "Passed").when(F.col("o_orderstatus") == "O", "Failed.").otherwise("In  progress")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see CS-"), F.col("o_custkey"), F.lit(" and CS-"), F.col("o_orderkey") % 10)).otherwise(F.concat(F.lit("none, "), F.col("o_orderstatus")))
    values = (
        F.when(F.col("kind") == 0, F.array(F.concat(F.lit("suite "), key), F.col("o_orderpriority"), text(n + 5), text(n), F.when(F.col("o_orderstatus") == "O", text(F.lit(3))), text(F.lit(2))))
        .when(F.col("kind") == 1, F.array(F.concat(F.lit("case "), key), F.col("o_orderpriority"), state, text(n + 1)))
        .when(F.col("kind") == 2, F.array(F.concat(F.lit("FL-"), key), note))
        .otherwise(F.array(F.concat(F.lit("area "), key), F.col("o_orderpriority"), text(n)))
    )
    heads = F.when(F.col("kind") == 0, F.array(*map(F.lit, ("Suite", "Priority", "TC count", "Pass", "Fail", "N/A")))).when(F.col("kind") == 1, F.array(*map(F.lit, ("Case", "Priority", "Status", "Test Cases")))).when(F.col("kind") == 2, F.array(*map(F.lit, ("ID", "Summary")))).otherwise(F.array(*map(F.lit, ("Name", "Priority", "Count"))))
    file = F.col("o_custkey").cast("string").alias("file")
    return o.select(file, F.lit(0).cast("long").alias("row_no"), heads.alias("cells")).distinct().union(o.select(file, (F.col("o_orderkey") + 1).alias("row_no"), values.alias("cells")))


BOARDS = """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS snapshot_id, o_custkey % 4 AS k, o_orderkey % 50 AS n, * FROM orders),
per AS (SELECT snapshot_id, k, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS prios, count(*) FILTER (o_orderstatus = 'O') AS fails, sum(n) AS pass, sum(n + 5) AS tc,
  coalesce(sum(n + 1) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS s_pass, coalesce(sum(n + 1) FILTER (o_orderstatus = 'O'), 0)::DOUBLE AS s_fail, coalesce(sum(n + 1) FILTER (o_orderstatus = 'P'), 0)::DOUBLE AS s_wait,
  count(*) FILTER (o_orderkey % 3 = 0) AS linked, CAST(coalesce(sum(CASE WHEN o_orderkey % 10 = o_custkey THEN 1 ELSE 2 END) FILTER (o_orderkey % 3 = 0), 0) AS BIGINT) AS links FROM o GROUP BY snapshot_id, k)
"""


def sheet_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return B.boards(I.load(board_grid(spark, sf_dir)))


@query(BOARDS + """, r AS (SELECT *, (pass + 3 * fails)::DOUBLE AS executed, (2 * n_rows)::DOUBLE AS na FROM per)
SELECT snapshot_id, CASE k WHEN 0 THEN 'run_results' WHEN 1 THEN 'status' WHEN 2 THEN 'inventory' ELSE 'volume' END AS kind, n_rows,
  CASE k WHEN 0 THEN 'columns “Pass” and “' || CASE WHEN fails = 0 THEN 'TC count' ELSE 'Fail' END || '” count outcomes' WHEN 1 THEN 'column “Status” holds an outcome for each row' WHEN 2 THEN 'column “ID” lists identifiers and nothing can be counted' ELSE 'no column holds outcomes' END AS reason,
  CASE WHEN k = 0 THEN 'n_a' WHEN k = 1 THEN 'test_cases' WHEN k = 3 THEN 'count' END AS measure,
  CASE k WHEN 0 THEN pass::DOUBLE WHEN 1 THEN s_pass END AS passed, CASE k WHEN 0 THEN (3 * fails)::DOUBLE WHEN 1 THEN s_fail END AS failed, CASE k WHEN 0 THEN na WHEN 1 THEN s_wait END AS waiting, CASE k WHEN 0 THEN tc::DOUBLE WHEN 1 THEN s_pass + s_fail + s_wait END AS total,
  CASE k WHEN 0 THEN CASE WHEN executed <> 0 THEN round(pass / executed * 100, 1) END WHEN 1 THEN CASE WHEN s_pass + s_fail <> 0 THEN round(s_pass / (s_pass + s_fail) * 100, 1) END END AS pass_rate_pct,
  CASE WHEN k = 0 THEN round(executed / tc * 100, 1) END AS executed_pct, CASE WHEN k = 0 THEN abs(tc - executed - na) < 0.5 END AS reconciles,
  CASE WHEN k = 2 THEN n_rows END AS items, CASE WHEN k = 2 THEN CASE WHEN linked >= 2 AND linked >= 0.25 * n_rows THEN linked ELSE 0 END END AS linked, CASE WHEN k = 2 THEN CASE WHEN linked >= 2 AND linked >= 0.25 * n_rows THEN links ELSE 0 END END AS links,
  CASE WHEN k = 2 THEN CASE WHEN linked >= 2 AND linked >= 0.25 * n_rows THEN 'CS' ELSE '' END END AS link_family, CASE WHEN k = 2 AND linked >= 2 AND linked >= 0.25 * n_rows THEN round(linked / n_rows * 100, 1) END AS linked_pct FROM r""")
def sheet_boards(spark, sf_dir):
    """From grids to the dashboard of each sheet: kind, reason and figures, whatever its columns are called."""
    f = B.figures(sheet_parts(spark, sf_dir))
    either = lambda a, b: F.coalesce(f"run.{a}", f"state.{b}")
    return f.select(
        "snapshot_id", "kind", "n_rows", "reason", "measure", either("passed", "passed").alias("passed"), either("failed", "failed").alias("failed"), either("not_run", "pending").alias("waiting"), either("total", "total").alias("total"),
        either("pass_rate_pct", "pass_rate_pct").alias("pass_rate_pct"), F.col("run.executed_pct").alias("executed_pct"), F.col("run.reconciles").alias("reconciles"),
        *[F.col(f"listed.{c}").alias(c) for c in ("items", "linked", "links", "link_family", "linked_pct")])


@query(BOARDS + """, w AS (SELECT snapshot_id, 'failing' AS list, 'suite ' || o_orderkey AS name, 3.0::DOUBLE AS amount, NULL AS status, row_number() OVER (PARTITION BY snapshot_id ORDER BY o_orderkey) AS rank, 10 AS most FROM o WHERE k = 0 AND o_orderstatus = 'O'
UNION ALL SELECT snapshot_id, 'open', 'case ' || o_orderkey, NULL, CASE o_orderstatus WHEN 'O' THEN 'Failed.' ELSE 'In progress' END, row_number() OVER (PARTITION BY snapshot_id ORDER BY o_orderkey), 20 FROM o WHERE k = 1 AND o_orderstatus <> 'F'
UNION ALL SELECT snapshot_id, 'largest', CASE k WHEN 0 THEN 'suite ' WHEN 1 THEN 'case ' ELSE 'area ' END || o_orderkey, CASE k WHEN 0 THEN 2 WHEN 1 THEN n + 1 ELSE n END, NULL, row_number() OVER (PARTITION BY snapshot_id ORDER BY CASE k WHEN 0 THEN 2 WHEN 1 THEN n + 1 ELSE n END DESC, o_orderkey), 10 FROM o WHERE k <> 2)
SELECT snapshot_id, list, name, amount, status, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= most""")
def sheet_lists(spark, sf_dir):
    """The failing, open and largest rows of each sheet; of labels the first part, as the others vary with the sheet."""
    return sheet_parts(spark, sf_dir)["lists"].select("snapshot_id", "list", F.substring_index("label", " · ", 1).alias("name"), "amount", "status", "rank")


@query(BOARDS + """, d AS (SELECT o.snapshot_id, o_orderpriority AS value, o.k, count(*) AS n_rows, sum(CASE WHEN o.k = 0 THEN n ELSE 0 END)::DOUBLE AS passed, sum(CASE WHEN o.k = 0 AND o_orderstatus = 'O' THEN 3 ELSE 0 END)::DOUBLE AS failed
  FROM o JOIN per p USING (snapshot_id) WHERE o.k IN (0, 3) AND p.prios >= 2 AND p.prios < p.n_rows GROUP BY ALL)
SELECT snapshot_id, value, n_rows, passed, failed, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY n_rows DESC, value) AS INTEGER) AS rank, CASE WHEN passed + failed <> 0 THEN round(passed / (passed + failed) * 100, 1) END AS pass_rate FROM d""")
def sheet_dimensions(spark, sf_dir):
    """The values of the dimension that each run and count sheet is broken down by."""
    parts = sheet_parts(spark, sf_dir)
    rows = parts["dimensions"].join(parts["roles"].filter("kind IN ('run_results', 'volume')").select("snapshot_id"), "snapshot_id", "left_semi")
    return rows.select("snapshot_id", "value", "n_rows", "passed", "failed", "rank", "pass_rate")


@query(BOARDS + """, e AS (SELECT snapshot_id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 10 = o_custkey THEN 1 ELSE 2 END ELSE 0 END AS links,
  CASE WHEN o_orderkey % 3 = 0 THEN 'see CS-' || o_custkey || ' and CS-' || o_orderkey % 10 ELSE 'none, ' || o_orderstatus END AS title FROM o WHERE k = 2),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.snapshot_id, e.links > 0 ORDER BY e.links DESC, o_orderkey) AS rank FROM e JOIN per USING (snapshot_id) WHERE linked >= 2 AND linked >= 0.25 * n_rows)
SELECT snapshot_id, CASE WHEN links > 0 THEN 'linked' ELSE 'unlinked' END AS kind, CAST(rank AS INTEGER) AS rank, 'FL-' || o_orderkey AS display, CAST(links AS BIGINT) AS links, title FROM r WHERE rank <= 20""")
def sheet_entries(spark, sf_dir):
    """The most linked and the unlinked entries of each list of identifiers, with their titles."""
    return sheet_parts(spark, sf_dir)["entries"]


@query("""SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS row_no,
  p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "new"' WHEN p_partkey % 3 = 1 THEN ' 5" wide' ELSE '' END || '|' || CASE WHEN p_partkey % 4 = 0 THEN 'two' || chr(10) || 'lines' WHEN p_partkey % 4 = 1 THEN '' ELSE p_type END || '|' || p_size AS cells FROM part""")
def csv_sheets(spark, sf_dir):
    """Brands' parts as CSV files with quoted commas, quotes and line ends, stray quotes and empty cells, read back as grids."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ', "new"').when(F.col("p_partkey") % 3 == 1, ' 5" wide').otherwise(""))
    kind = F.when(F.col("p_partkey") % 4 == 0, quoted(F.lit("two\nlines"))).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.col("p_type"))
    line = F.concat(F.when(F.col("p_partkey") % 3 == 0, quoted(name)).otherwise(name), F.lit(","), kind, F.lit(","), "p_size")
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_partkey", line.alias("line"))
    path = new_folder(spark, "csv")
    lines.repartition("brand").sortWithinPartitions("brand", "p_partkey").drop("p_partkey").write.partitionBy("brand").text(path)  # a brand is one file
    brand = F.url_decode(F.url_decode(F.regexp_extract("_metadata.file_path", "/brand=([^/]*)/", 1)))
    return X.csv_grid(spark, path, brand).select("file", "row_no", F.array_join("cells", "|", "").alias("cells"))


WAVES = ("1994-01-01", "1994-02-01", "1998-01-01")


@query(f"""WITH w(wave, until) AS (VALUES (0, TIMESTAMP '{WAVES[0]}'), (1, TIMESTAMP '{WAVES[1]}'), (2, TIMESTAMP '{WAVES[2]}')),
n AS (SELECT CAST(o_custkey AS VARCHAR) AS file, wave, count(*) AS n FROM orders JOIN w ON o_orderdate < until GROUP BY ALL),
c AS (SELECT *, n IS DISTINCT FROM lag(n) OVER (PARTITION BY file ORDER BY wave) AS changed FROM n)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY wave) AS sequence, n AS row_count FROM c WHERE changed""")
def streamed_loads(spark, sf_dir):
    """Customers' orders arrive three times, as they stood at three dates: a version of each sheet that changed since."""
    o = table(spark, sf_dir, "orders")
    row = F.struct(F.col("o_orderkey").cast("int").alias("row_no"), F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")).alias("cells"))
    src, out = new_folder(spark, "arrivals"), new_folder(spark, "versions")
    mark = new_folder(spark, "stream")
    for n, until in enumerate(WAVES):
        o.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz")).select(F.col("o_custkey").cast("string").alias("file"), row.alias("r")).select("file", "r.*").write.mode("append").parquet(src)
        told = L.changes(spark, src).writeStream.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/{batch}"))
        told.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(L.CHANGES).parquet(*[f"{out}/{n}" for n in range(len(WAVES))]).select("file", "sequence", "row_count").distinct()
