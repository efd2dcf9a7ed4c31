"""Data-quality and text-check queries: line items as sheets, documents as written reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import facts as G
from gridledger.operators import ingest as I
from gridledger.operators import quality as Q
from gridledger.operators import snapshots as S
from gridledger.plans.coverage import F_SQL, REFERENCES, TOKENS_SQL, references
from gridledger.plans.registry import query, table
from gridledger.sources.kept import kept

SHEETS = """WITH li AS (SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS row_index, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_returnflag END AS flag, CASE WHEN (l_orderkey + l_linenumber) % 40 = 0 THEN 'see notes' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
  CASE WHEN l_orderkey % 9 = 0 THEN 'n/a ' || l_linenumber END AS remark, CASE WHEN l_suppkey % 2 = 0 AND l_orderkey % 7 = 0 THEN 'none' END AS skip FROM lineitem)
"""
LABELS = ((0, "flag", "Flag", "string"), (1, "qty", "Test Count", "number"), (2, "remark", "Failures", "string"), (3, "skip", "Not run", "string"), (4, "owner", "Owner", "string"))


def sheets(spark, sf_dir):
    """Line items of a supplier as a sheet: some quantities are words, remarks are rare, a column is never filled."""
    li = table(spark, sf_dir, "lineitem")
    rare = F.col("l_orderkey") % 9 == 0
    qty = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 40 == 0, "see notes").otherwise(F.col("l_quantity").cast("long").cast("string"))
    rows = li.select(
        F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"), F.when(~rare, F.col("l_returnflag")).alias("flag"), qty.alias("qty"),
        F.when(rare, F.concat(F.lit("n/a "), "l_linenumber")).alias("remark"), F.when((F.col("l_suppkey") % 2 == 0) & (F.col("l_orderkey") % 7 == 0), "none").alias("skip"), F.lit(None).cast("string").alias("owner"))
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("key"), F.col(c).alias("s"), T.number_of(c).alias("n")) for i, c, _, _ in LABELS])
    cells = rows.select("file", "row_index", F.explode(items).alias("c")).select("file", "row_index", "c.*")
    kinds = spark.createDataFrame(list(LABELS), "pos int, key string, label string, type string")
    columns = rows.select("file").distinct().crossJoin(F.broadcast(kinds))  # five rows
    return rows, cells, columns


def warnings(spark, sf_dir):
    """All warnings of the sheets of line items: of columns, duplicates, structure, and identifiers."""
    rows, cells, columns = sheets(spark, sf_dir)
    n = rows.groupBy("file").agg(F.count("*").alias("n_rows"))
    fill = kept(Q.column_fill(cells, "file"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), "l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"))
    dropped = S.dedupe_first(li, ["file"], "l_partkey", "row_index", ["l_quantity"])[1]
    bare = rows.select("file").distinct().withColumn("header_row", F.when(F.col("file") % 4 != 0, 0))
    blank = rows.groupBy("file").agg(F.count_if(F.col("remark").isNotNull()).alias("separators"))
    moved = rows.select("file").distinct().filter("file % 3 = 0").select("file", F.lit("unknown_id_reference").alias("code"), F.lit("notice").alias("severity"), F.lit("an old warning").alias("message"))
    named = rows.filter((F.col("file") % 5 == 0) & (F.col("row_index") % 10 == 1)).select("file", "row_index", F.concat(F.lit("QX-"), F.col("row_index")).alias("display"), F.concat(F.lit("QX-"), F.col("row_index") + 10).alias("token"), F.lit("as below").alias("snippet"), F.lit(True).alias("inside"))
    return [Q.fill_warnings(fill, columns, n, "file"), Q.measure_warnings(fill, columns, "file"), Q.duplicate_warnings(dropped, "file", "l_partkey", "row_index"), Q.structure_warnings(blank, bare), Q.mismatch_warnings(named, "file", "row_index"), moved]


@query(SHEETS + """, n AS (SELECT file, count(*) AS n, count(*) FILTER (qty = 'see notes') AS strays, count(flag) AS flags, count(remark) AS remarks, count(skip) AS skips FROM li GROUP BY file),
shown AS (SELECT file, string_agg('“' || remark || '”', ', ' ORDER BY row_index) AS remarks FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_index) AS r FROM li WHERE remark IS NOT NULL) WHERE r <= 2 GROUP BY file),
r AS (SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS row_index, l_partkey, l_quantity, first_value(l_quantity) OVER w AS kq, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber)),
c AS (SELECT file, count(*) FILTER (l_quantity <> kq) AS a, count(*) FILTER (l_quantity = kq) AS b, arg_min(l_partkey, row_index) FILTER (l_quantity <> kq) AS first FROM r WHERE n > 1 GROUP BY file),
w AS (SELECT file, 3 AS o, 'text_in_measure' AS code, 'problem' AS severity, 'Test Count is short by ' || strays || ' of ' || n || ' cells that are not numbers: ' || array_to_string(list_resize(['“see notes”', '“see notes”', '“see notes”'], least(3, strays)), ', ') || '.' AS message FROM n WHERE strays > 0
UNION ALL SELECT file, 2, 'measure_column_not_numeric', 'problem', 'Failures is named like a count but holds text: ' || shown.remarks || '.' FROM n JOIN shown USING (file)
UNION ALL SELECT file, 2, 'measure_column_not_numeric', 'problem', 'Not run is named like a count but holds text: ' || CASE WHEN skips > 1 THEN '“none”, “none”' ELSE '“none”' END || '.' FROM n WHERE skips > 0
UNION ALL SELECT file, 7, 'empty_columns', 'notice', len(x) || ' column(s) are never filled: ' || array_to_string(x[1:3], ', ') || CASE WHEN len(x) > 3 THEN ' +' || (len(x) - 3) || ' more' ELSE '' END || '.' FROM (
  SELECT file, list_filter([CASE WHEN flags = 0 THEN 'Flag' END, CASE WHEN remarks = 0 THEN 'Failures' END, CASE WHEN skips = 0 THEN 'Not run' END, 'Owner'], lambda v: v IS NOT NULL) AS x FROM n)
UNION ALL SELECT file, 8, 'sparse_columns', 'notice', len(x) || ' column(s) are filled on almost no rows: ' || array_to_string(x, ', ') || '.' FROM (
  SELECT file, list_filter([CASE WHEN flags > 0 AND flags / n < 0.2 THEN 'Flag (' || flags || ' of ' || n || ')' END, CASE WHEN remarks > 0 AND remarks / n < 0.2 THEN 'Failures (' || remarks || ' of ' || n || ')' END, CASE WHEN skips > 0 AND skips / n < 0.2 THEN 'Not run (' || skips || ' of ' || n || ')' END], lambda v: v IS NOT NULL) AS x FROM n) WHERE len(x) > 0
UNION ALL SELECT file, 1, 'conflicting_duplicate', 'problem', a || ' dropped row(s) disagree with the row that was kept, first ' || first || ' in l_quantity.' FROM c WHERE a > 0
UNION ALL SELECT file, 5, 'duplicate_rows', 'notice', b || ' row(s) repeat an earlier row exactly.' FROM c WHERE b > 0
UNION ALL SELECT file, 6, 'separator_rows', 'notice', remarks || ' row(s) without any number were read as separators.' FROM n WHERE remarks > 0
UNION ALL SELECT file, 9, 'no_header', 'notice', 'The sheet has no header row, so its columns are numbered.' FROM n WHERE file % 4 = 0
UNION ALL SELECT file, 4, 'mismatched_id', 'problem', count(*) || ' row(s) of one QX id tell of another row''s; the first is QX-' || min(row_index) || ', whose “as below” names QX-' || (min(row_index) + 10) || '.' FROM li WHERE file % 5 = 0 AND row_index % 10 = 1 GROUP BY file)
SELECT * FROM (SELECT file, code, severity, message, CAST(row_number() OVER (PARTITION BY file ORDER BY o, message) AS INTEGER) AS rank FROM w) WHERE rank <= 8""")
def quality_report(spark, sf_dir):
    """The first eight warnings of each sheet, of up to ten; those that moved elsewhere don't count."""
    parts = warnings(spark, sf_dir)
    return Q.inspect([*parts[:-1], Q.drop_moved(parts[-1])], "file")


@query("""SELECT DISTINCT l_suppkey AS file, 'measure_column_not_numeric' AS code FROM lineitem WHERE l_orderkey % 9 = 0 OR (l_suppkey % 2 = 0 AND l_orderkey % 7 = 0)""")
def kept_warnings(spark, sf_dir):
    """Stored warnings, some with a code that has moved: which sheets have a column named like a count that holds text."""
    parts = warnings(spark, sf_dir)
    stored = parts[1].unionByName(parts[-1])
    return Q.drop_moved(stored).filter("code <> 'text_in_measure'").select("file", "code").distinct()


@query("""WITH r AS (SELECT l_suppkey AS file, l_quantity <> first_value(l_quantity) OVER w AS differs, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber)),
c AS (SELECT file, count(*) FILTER (differs) AS a, count(*) FILTER (NOT differs) AS b FROM r WHERE n > 1 GROUP BY file)
SELECT file, 'conflicting_duplicate' AS code, 'problem' AS severity, a || ' dropped row(s) disagree with the row that was kept.' AS message FROM c WHERE a > 0 UNION ALL
SELECT file, 'duplicate_rows', 'notice', b || ' row(s) repeat an earlier row exactly.' FROM c WHERE b > 0""")
def duplicate_warnings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), "l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"))
    return Q.duplicate_warnings(S.dedupe_first(li, ["file"], "l_partkey", "row_index", ["l_quantity"])[1], "file")


@query(f"""WITH {F_SQL}, {REFERENCES}
SELECT file, 'mismatched_id' AS code, 'problem' AS severity, count(*) || ' row(s) of one FL id tell of another row''s; the first is ' || arg_min(display, row_index) || ', whose “' || arg_min(snippet, row_index) || '” names ' || arg_min(token, row_index) || '.' AS message FROM refs WHERE inside GROUP BY file""")
def mismatch_warnings(spark, sf_dir):
    """Orders whose notes name another order of the same customer."""
    return Q.mismatch_warnings(references(spark, sf_dir), "file", "row_index")


@query("""WITH d AS (SELECT source, md5(text) AS h, doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS r FROM documents)
SELECT source AS layer, 'identical_workbooks' AS code, 'problem' AS severity, count(*) || ' workbooks hold identical contents, so their rows count more than once: ' || string_agg(doc_id, ',' ORDER BY doc_id) FILTER (r <= 10) || '.' AS message FROM d GROUP BY source, h HAVING count(*) > 1""")
def identical_warnings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("layer"), "doc_id", F.md5("text").alias("content_hash"))
    return Q.identical_warnings(S.identical_files(d, ["layer"], "content_hash", "doc_id"), "layer")


# Thousands commas: one after a digit and before three digits and no more. Twice, as neighbours share a digit group;
# a mark stands for a comma that goes, until all are found.
_COMMAS = r"replace(regexp_replace(regexp_replace({}, '(\d),(\d{{3}})(\D|$)', '\1' || chr(1) || '\2\3', 'g'), '(\d),(\d{{3}})(\D|$)', '\1' || chr(1) || '\2\3', 'g'), chr(1), '')"
FIGURES = "list_distinct(list_transform(regexp_extract_all(" + _COMMAS + r", '\d+(?:\.\d+)?'), lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(regexp_replace(x, '^0+(\d)', '\1'), '\.0+$', ''), '(\.\d*[1-9])0+$', '\1') ELSE regexp_replace(x, '^0+(\d)', '\1') END))"


@query(f"""SELECT figure, count(*) AS n_docs FROM (SELECT doc_id, unnest({FIGURES.format("coalesce(text, '')")}) AS figure FROM documents) GROUP BY figure""")
def document_figures(spark, sf_dir):
    """In how many documents each number stands."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.figures("text")).alias("figure"))
    return d.groupBy("figure").agg(F.count("*").alias("n_docs"))


@query(f"""SELECT o_orderkey, array_to_string(list_sort({FIGURES.format("note")}), ' ') AS figures FROM (SELECT o_orderkey, format('{{:,}}', CAST(o_totalprice * 1000 AS BIGINT)) || ' of ' || o_orderkey || ',' || o_custkey || ' and 1,2' || o_custkey || '.50' AS note FROM orders)""")
def order_figures(spark, sf_dir):
    """Figures of notes in which commas part thousands or not."""
    price = F.format_number(F.round(F.col("o_totalprice") * 1000, 0), 0)
    note = F.concat(price, F.lit(" of "), "o_orderkey", F.lit(","), "o_custkey", F.lit(" and 1,2"), "o_custkey", F.lit(".50"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(T.figures(note)), " ").alias("figures"))


@query(f"""WITH said AS (SELECT DISTINCT source AS report, unnest({FIGURES.format("coalesce(text, '')")}) AS figure FROM documents), known AS (SELECT DISTINCT source AS report, unnest({FIGURES.format("'facts ' || n_chars || ' of ' || doc_id")}) AS figure FROM documents)
SELECT * FROM said ANTI JOIN known USING (report, figure)""")
def unverified_figures(spark, sf_dir):
    """A source's documents are the claims of one report; its facts are their sizes and numbers."""
    d = table(spark, sf_dir, "documents").withColumn("report", F.col("source"))
    facts = d.withColumn("facts", F.concat(F.lit("facts "), "n_chars", F.lit(" of "), "doc_id"))
    return G.unverified(d, facts, "report", "text", "facts")


@query(f"""WITH said AS (SELECT DISTINCT source AS report, unnest({FIGURES.format("coalesce(text, '')")}) AS figure FROM documents), want AS (SELECT source AS report, 'size ' || doc_id AS label, CAST(n_chars AS VARCHAR) AS figure FROM documents)
SELECT DISTINCT report, md5(label) AS line, true AS added FROM want ANTI JOIN said USING (report, figure) UNION ALL SELECT source, md5(text), false FROM documents""")
def missing_figures(spark, sf_dir):
    """All claims, and a line for each figure that none of them gives."""
    d = table(spark, sf_dir, "documents").withColumn("report", F.col("source"))
    needed = d.select("report", F.concat(F.lit("size "), "doc_id").alias("label"), F.col("n_chars").alias("value"))
    missing = G.missing_figures(d, needed, "report", "text")
    return G.fill_gaps(d, missing, "report", "text").select("report", F.md5("text").alias("line"), "added")


@query(TOKENS_SQL + r""", said AS (SELECT DISTINCT source AS report, lower(regexp_replace(t, '[\s\-_]+', '', 'g')) AS c FROM (SELECT source, unnest(found) AS t FROM tokens))
SELECT source AS report, 'lor ' || n AS id FROM (SELECT DISTINCT source FROM documents), range(10) r(n) WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.report = source AND c = 'lor' || n)""")
def missing_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("report"), "text")
    needed = d.select("report").distinct().select("report", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).select("report", F.concat(F.lit("lor "), "n").alias("id"))
    return G.missing_ids(d, needed, "report", "text").select("report", "id")


@query("""WITH w AS (SELECT DISTINCT source AS report, l AS layer FROM documents, (VALUES ('the layer'), ('zzzq layer')) t(l))
SELECT report, layer, 'text_in_measure' AS code FROM w WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = w.report AND contains(lower(d.text), split_part(w.layer, ' ', 1)) AND contains(lower(d.text), 'text'))""")
def missing_warnings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("report"), "text")
    w = d.select("report").distinct().select("report", F.explode(F.array(F.lit("the layer"), F.lit("zzzq layer"))).alias("layer"), F.lit("text_in_measure").alias("code"), F.lit("problem").alias("severity"))
    return G.missing_warnings(d, w, "report", "text")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE '' END AS sources, trim(o_orderpriority)[1:89] AS title FROM orders""")
def cleaned_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sources = G.clean_sources(F.array("o_orderstatus", "o_orderstatus", "o_orderpriority"), F.array(F.lit("F"), F.lit("O")))
    return o.select("o_orderkey", F.array_join(sources, ",").alias("sources"), G.title_of(["o_orderkey", "o_orderpriority"]).alias("title"))


@query(SHEETS + """SELECT CASE WHEN qty = 'see notes' THEN 'A A' ELSE '#' END AS shape, count(*) AS n, CAST(sum(TRY_CAST(qty AS BIGINT)) AS BIGINT) AS total FROM li GROUP BY 1""")
def cell_shapes(spark, sf_dir):
    cell = sheets(spark, sf_dir)[0].withColumn("c", T.norm_cell(F.concat(F.lit("  "), "qty", F.lit(" "))))
    return cell.groupBy(T.cell_shape("c.s", "c.n").alias("shape")).agg(F.count("*").alias("n"), F.sum("c.n").cast("long").alias("total"))


@query("""SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'total_tests' ELSE 'size_' || p_size END AS measure, count(*) AS n FROM part GROUP BY ALL""")
def measure_identities(spark, sf_dir):
    """Parts' sizes as labels of columns: every third counts tests, in other words."""
    form = F.element_at(F.array(*map(F.lit, ("No. of Test Cases", " TC-Count", "total   tests"))), (F.pmod("p_size", F.lit(9)) / 3 + 1).cast("int"))
    label = F.when(F.col("p_size") % 3 == 0, form).otherwise(F.concat(F.lit("Automated Test Count "), "p_size"))
    p = table(spark, sf_dir, "part").select("p_brand", T.measure_identity(label, F.concat(F.lit("size_"), "p_size")).alias("measure"))
    return p.groupBy("p_brand", "measure").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_suppkey AS file, count(*) FILTER (l_orderkey % 50 = 0) AS separators FROM lineitem GROUP BY 1)
SELECT file, 'separator_rows' AS code, 'notice' AS severity, separators || ' row(s) without any number were read as separators.' AS message FROM m WHERE separators > 0
UNION ALL SELECT file, 'no_header', 'notice', 'The sheet has no header row, so its columns are numbered.' FROM m WHERE file % 4 = 0""")
def structure_warnings(spark, sf_dir):
    """Line items of a supplier whose numbers are blank for some orders; every fourth sheet has no header."""
    blank = lambda c: F.when(F.col("l_orderkey") % 50 != 0, T.norm_cell(F.col(c).cast("string")))
    li = table(spark, sf_dir, "lineitem")
    data = li.select(F.col("l_suppkey").alias("file"), F.array(T.norm_cell("l_returnflag"), blank("l_quantity"), blank("l_tax")).alias("vals"))
    kinds = spark.createDataFrame([(0, "Flag"), (1, "Quantity"), (2, "Tax")], "pos int, label string")
    columns = li.select(F.col("l_suppkey").alias("file")).distinct().crossJoin(F.broadcast(kinds))  # three rows
    data, columns = kept(data), kept(columns)  # cells are normalised once
    separators = I.drop_separators(data, I.infer_types(data, columns))[1]
    headers = columns.select("file").distinct().withColumn("header_row", F.when(F.col("file") % 4 != 0, 0))
    return Q.structure_warnings(separators, headers)
