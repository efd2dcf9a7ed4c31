"""Data-quality warnings of many files: (file, code, severity, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators.dashboards import FAIL_LABEL, NOT_RUN_LABEL, PASS_LABEL, TOTAL_LABEL

# Fixed values that results depend on: the order in which warnings are listed, and labels that promise a number.
CODES = (
    "conflicting_duplicate", "measure_column_not_numeric", "text_in_measure", "mismatched_id",
    "duplicate_rows", "separator_rows", "empty_columns", "sparse_columns", "no_header",
)
MOVED = ("unknown_id_reference",)
MEASURE_LABELS = (TOTAL_LABEL, PASS_LABEL, FAIL_LABEL, NOT_RUN_LABEL)
SPARSE_SHARE = 0.2
MOST, NAMED = 8, 3


def _warning(code: str, severity: str, message: Column) -> list[Column]:
    return [F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")]


def _names(values: Column) -> Column:
    """Three names and how many more."""
    more = F.size(values) - NAMED
    return F.concat(F.array_join(F.slice(values, 1, NAMED), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def duplicate_warnings(dropped: DataFrame, by: str, label: str | None = None, order: str | None = None) -> DataFrame:
    """From dropped duplicates with their conflicts: rows that disagree, and rows that repeat exactly.

    With label and order, the first that disagrees is named, and the measures in which it does."""
    bad_row = F.size("conflicts") > 0
    first = F.min_by(F.when(bad_row, F.struct(F.col(label).cast("string").alias("label"), F.array_join(F.slice("conflicts", 1, 2), ", ").alias("in"))), F.when(bad_row, F.col(order))) if label else F.lit(None)
    a = dropped.groupBy(by).agg(F.count_if(bad_row).alias("conflicting"), F.count_if(~bad_row).alias("same"), first.alias("first"))
    text = F.concat(F.col("conflicting").cast("string"), F.lit(" dropped row(s) disagree with the row that was kept"))
    text = F.concat(text, F.lit(", first "), F.col("first.label"), F.lit(" in "), F.col("first.in"), F.lit(".")) if label else F.concat(text, F.lit("."))
    bad = a.filter("conflicting > 0").select(by, *_warning("conflicting_duplicate", "problem", text))
    same = a.filter("same > 0").select(by, *_warning("duplicate_rows", "notice", F.concat(F.col("same").cast("string"), F.lit(" row(s) repeat an earlier row exactly."))))
    return bad.unionByName(same)


def column_fill(cells: DataFrame, by: str, order: str = "row_index") -> DataFrame:
    """by, key, filled, strays (filled but no numbers) and the first values of both kinds: what the checks of columns read.

    One grouping serves them all; of the values only the first few of each task meet."""
    a = cells.filter(F.col("s").isNotNull())
    text = a.filter(F.col("n").isNull())
    place = F.row_number().over(Window.partitionBy(by, "key").orderBy(order))
    shown = text.select(by, "key", order, "s").withColumn("_r", place).filter(F.col("_r") <= NAMED).groupBy(by, "key")
    shown = shown.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "s"))), lambda x: x["s"]).alias("samples"))  # a few values
    n = a.groupBy(by, "key").agg(F.count("*").alias("filled"), F.count_if(F.col("n").isNull()).alias("strays"))
    return n.join(shown, [by, "key"], "left")


def measure_warnings(fill: DataFrame, columns: DataFrame, by: str) -> DataFrame:
    """Number columns with text cells, and text columns named like a measure, with a few of the cells. fill: column_fill."""
    a = fill.join(columns.select(by, "key", "label", "type"), [by, "key"])
    quoted = lambda n: F.array_join(F.transform(F.slice("samples", 1, n), lambda v: F.concat(F.lit("“"), v, F.lit("”"))), ", ")
    short = a.filter((F.col("type") == "number") & (F.col("strays") > 0))
    short = short.select(by, *_warning("text_in_measure", "problem", F.concat("label", F.lit(" is short by "), F.col("strays").cast("string"), F.lit(" of "), F.col("filled").cast("string"), F.lit(" cells that are not numbers: "), quoted(NAMED), F.lit("."))))
    text = a.filter((F.col("type") != "number") & T.any_of([F.col("label").rlike(p) for p in MEASURE_LABELS]))
    told = F.when(F.size("samples") > 0, F.concat(F.lit(": "), quoted(2), F.lit("."))).otherwise(F.lit("."))
    return short.unionByName(text.select(by, *_warning("measure_column_not_numeric", "problem", F.concat("label", F.lit(" is named like a count but holds text"), told))))


def fill_warnings(fill: DataFrame, columns: DataFrame, n_rows: DataFrame, by: str) -> DataFrame:
    """Columns that are never filled, or on under a fifth of the rows; one warning of each kind for a file."""
    a = columns.join(fill.select(by, "key", "filled"), [by, "key"], "left").join(n_rows, by).withColumn("filled", F.coalesce("filled", F.lit(0)))
    listed = lambda cond, text: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", text.alias("text"))))), lambda x: x["text"])
    sparse = (F.col("filled") > 0) & (F.col("filled") / F.col("n_rows") < SPARSE_SHARE)
    share = F.concat("label", F.lit(" ("), F.col("filled").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(")"))
    g = a.groupBy(by).agg(listed(F.col("filled") == 0, F.col("label")).alias("empty"), listed(sparse, share).alias("sparse"))  # columns of one file
    text = lambda c, end: F.concat(F.size(c).cast("string"), F.lit(end), _names(F.col(c)), F.lit("."))
    return (
        g.filter(F.size("empty") > 0).select(by, *_warning("empty_columns", "notice", text("empty", " column(s) are never filled: ")))
        .unionByName(g.filter(F.size("sparse") > 0).select(by, *_warning("sparse_columns", "notice", text("sparse", " column(s) are filled on almost no rows: "))))
    )


def identical_warnings(identical: DataFrame, by: str) -> DataFrame:
    """Contents that several files of a layer share (n_files and files, as snapshots.identical_files gives them)."""
    text = F.concat(F.col("n_files").cast("string"), F.lit(" workbooks hold identical contents, so their rows count more than once: "), F.col("files"), F.lit("."))
    return identical.select(by, *_warning("identical_workbooks", "problem", text))


def structure_warnings(separators: DataFrame, headers: DataFrame, by: str = "file") -> DataFrame:
    """Separator rows that were dropped, and sheets without a header row."""
    a = separators.filter("separators > 0").select(by, *_warning("separator_rows", "notice", F.concat(F.col("separators").cast("string"), F.lit(" row(s) without any number were read as separators."))))
    b = headers.filter(F.col("header_row").isNull()).select(by, *_warning("no_header", "notice", F.lit("The sheet has no header row, so its columns are numbered.")))
    return a.unionByName(b)


def mismatch_warnings(references: DataFrame, by: str, order: str) -> DataFrame:
    """Rows that name another identifier of their own file: how many, the family, and the first of them with its text.

    references: by, order, display, token, snippet, inside, as id_references gives them."""
    first = F.min(F.struct(F.col(order), F.col("token"), F.col("display"), F.col("snippet"))).alias("first")
    a = references.filter("inside").groupBy(by).agg(F.count("*").alias("n"), first)
    told = F.format_string("%d row(s) of one %s id tell of another row's; the first is %s, whose “%s” names %s.", F.col("n"), T.family_of("first.token"), F.col("first.display"), F.col("first.snippet"), F.col("first.token"))
    return a.select(by, *_warning("mismatched_id", "problem", told))


def inspect(warnings: list[DataFrame], by: str, most: int = MOST) -> DataFrame:
    """All warnings in their fixed order, at most `most` for each file."""
    out = warnings[0]
    for w in warnings[1:]:
        out = out.unionByName(w)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code")), F.lit(0))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_rank", "message"))
    return out.withColumn("_rank", F.when(rank > 0, rank).otherwise(len(CODES) + 1)).withColumn("rank", place).filter(F.col("rank") <= most).drop("_rank")


def drop_moved(warnings: DataFrame) -> DataFrame:
    """Stored warnings without codes that other reports have taken over."""
    return warnings.filter(~F.col("code").isin(*MOVED))
