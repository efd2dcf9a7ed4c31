"""From messy sheet grids to typed rows.

A grid is (file, row_no, cells ARRAY<STRING>). What a row means depends on the rows before it, so rows go through
the ordered machines of `scan`; long files block by block: none is one task's work, however long it is. Tables of a row a
file are kept before rows meet them: where they are few their size is known, they are broadcast, and rows are not dealt by
file (of tables it has just dealt, Spark doesn't broadcast one whose rows are all in a few partitions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators.scan import ABOVE, BLOCK, DATA, HARD, SOFT, Titles, Values, block_scan, sheet_scan
from gridledger.sources.kept import kept

MAX_ROWS = 20_000
BELOW_ROWS = 30
NUMBER_SHARE = 0.6
DEFAULT_SECTION = "General"


def normalise(grid: DataFrame) -> DataFrame:
    """grid with cells as structs (s, n), filled (places of filled cells), width (their number), and texts: whether none is a number."""
    out = grid.select("file", "row_no", F.transform("cells", lambda c: T.norm_cell(c)).alias("cells"))
    places = F.array_compact(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i)))
    texts = ~F.exists("cells", lambda c: F.coalesce(c["n"].isNotNull(), F.lit(False)))
    return out.withColumn("filled", places).withColumn("width", F.size("filled")).withColumn("texts", texts)


def dominant_width(rows: DataFrame) -> DataFrame:
    """file, mode_width: the commonest number of filled cells over 1, the larger on ties."""
    n = rows.filter("width >= 2").groupBy("file", "width").agg(F.count("*").alias("n"))
    return n.groupBy("file").agg(F.max_by("width", F.struct("n", "width")).alias("mode_width"))


def header_candidates(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """file, pass_no, row_no: the first row that each of the three passes may take as header."""
    each = rows.filter("width >= 2").groupBy("file", "width").agg(F.min(F.when(F.col("texts"), F.col("row_no"))).alias("text"), F.min("row_no").alias("any"))
    firsts = each.join(widths, "file").groupBy("file").agg(F.min(F.when(F.col("width") == F.col("mode_width"), F.col("text"))).alias("p1"), F.min("text").alias("p2"), F.min("any").alias("p3"))
    return firsts.select("file", F.posexplode(F.array("p1", "p2", "p3")).alias("pass_no", "row_no")).filter(F.col("row_no").isNotNull())


def looks_like_values(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with is_data: the row has the shapes of the values below it, in two columns and half of its cells; and
    with head, its filled cells as (col_no, text).

    A candidate and its rows below come from one read of the rows of its width; the candidate stands at place 0."""
    cand = candidates.select("file", F.col("row_no").alias("head")).distinct()
    width = kept(cand.join(rows.select("file", F.col("row_no").alias("head"), F.col("width").alias("w")), ["file", "head"]))
    near = rows.join(width, "file").filter((F.col("row_no") >= F.col("head")) & (F.col("width") == F.col("w")))
    place = F.row_number().over(Window.partitionBy("file", "head").orderBy("row_no"))
    # the plain comparison lets Spark drop further rows before they are dealt by file
    near = near.withColumn("_r", place).filter(F.col("_r") <= BELOW_ROWS + 1).withColumn("_r", F.col("_r") - 1)
    cell = near.select("file", "head", "w", "_r", F.posexplode("cells").alias("col_no", "c")).filter(F.col("c").isNotNull())
    shape = T.cell_shape("c.s", "c.n").alias("shape")
    # every row has cells, so the last place below is told by them too
    own = lambda c: F.max(F.when(F.col("_r") == 0, c))
    shapes = cell.groupBy("file", "head", "w", "col_no", shape).agg(
        F.count_if(F.col("_r") > 0).alias("n"), F.min(F.when(F.col("_r") > 0, F.col("_r"))).alias("at"), own(F.lit(True)).alias("own"), own(F.col("c.s")).alias("text"), F.max("_r").alias("last"))
    common = shapes.groupBy("file", "head", "w", "col_no").agg(
        F.max_by("shape", F.struct("n", -F.coalesce("at", F.lit(BELOW_ROWS + 1)))).alias("shape"), F.max("n").alias("n"), F.sum("n").alias("seen"),
        F.max(F.when(F.col("own"), F.col("shape"))).alias("own"), F.max("text").alias("text"), F.max("last").alias("last"))
    strong = (F.col("seen") >= 2) & (F.col("n") * 2 >= F.col("seen")) & F.col("shape").rlike("[9#]") & F.col("own").eqNullSafe(F.col("shape"))
    cells = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("col_no", "text"))))  # of one row
    out = common.groupBy("file", "head", "w").agg(F.count_if(strong).alias("strong"), F.max("last").alias("n_below"), cells.alias("cells"))
    is_data = (F.col("n_below") >= 2) & (F.col("strong") >= 2) & (F.col("strong") * 2 >= F.col("w"))
    return candidates.join(out.select("file", F.col("head").alias("row_no"), is_data.alias("is_data"), F.col("cells").alias("head")), ["file", "row_no"])


def find_headers(rows: DataFrame) -> DataFrame:
    """file, header_row (null if every column is only numbered), start, labels; files without any are left out."""
    widths = kept(dominant_width(rows))
    tried = looks_like_values(rows, header_candidates(rows, widths))
    head = tried.filter(~F.col("is_data")).groupBy("file").agg(F.min_by(F.struct("row_no", "head"), "pass_no").alias("h"))
    first = rows.filter("width >= 2").groupBy("file", F.col("width").alias("mode_width")).agg(F.min_by(F.get("filled", 0), "row_no").alias("first"))
    base = widths.join(first, ["file", "mode_width"]).join(head, "file", "left")
    numbered = F.transform(F.sequence(F.lit(1), F.col("mode_width")), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    named = F.transform("h.head", lambda c: c["text"])
    return base.select("file", F.col("h.row_no").alias("header_row"), F.coalesce(F.get("h.head", 0)["col_no"], "first").alias("start"), F.coalesce(named, numbered).alias("labels"))


def column_keys(headers: DataFrame) -> DataFrame:
    """file, pos, key, label: repeated keys get _2, _3."""
    each = headers.select("file", F.posexplode("labels").alias("pos", "label")).withColumn("key", T.column_key("label"))
    n = F.row_number().over(Window.partitionBy("file", "key").orderBy("pos"))
    return each.withColumn("_n", n).select("file", "pos", F.when(F.col("_n") > 1, F.concat_ws("_", "key", F.col("_n").cast("string"))).otherwise(F.col("key")).alias("key"), "label")


def body_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The filled rows but the header: file, row_no, kind, value (the text of a lone cell, or of a row above the header, its
    first) and vals, aligned to the header; repeated headers are left out.

    A lone cell at or before the first column, or past the last, is a section title; one in between may be. A row of
    texts of which half match the header repeats it and counts as nothing."""
    h = headers.withColumn("n_cols", F.size("labels"))
    body = rows.join(h, "file").filter((F.col("width") > 0) & (F.col("header_row").isNull() | (F.col("row_no") != F.col("header_row"))))
    above = F.coalesce(F.col("row_no") < F.col("header_row"), F.lit(False))
    end = F.col("start") + F.col("n_cols")
    cut = F.slice("cells", F.col("start") + 1, F.col("n_cols"))
    vals = F.when(F.size("cells") >= end, cut).otherwise(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.get("cells", i + F.col("start"))))
    texts = F.exists(cut, lambda v: v.isNotNull()) & ~F.exists(cut, lambda v: F.coalesce(v["n"].isNotNull(), F.lit(False)))
    match = F.size(F.filter(F.zip_with(cut, "labels", lambda v, l: F.coalesce(v["s"] == l, F.lit(False))), lambda b: b))
    repeat = ~above & (F.col("width") > 1) & texts & (match >= F.greatest(F.lit(2), F.floor((F.col("n_cols") + 1) / 2)))
    at, lone = F.get("filled", 0), F.col("width") == 1
    kind = F.when(above, ABOVE).when(~lone, DATA).when((at <= F.col("start")) | (at >= end), HARD).otherwise(SOFT)
    return body.filter(~repeat).select("file", "row_no", kind.alias("kind"), F.when(above | lone, _first_text("cells")).alias("value"), F.when(~above, vals).alias("vals"))


def _first_text(cells: str) -> Column:
    return F.get(F.filter(cells, lambda c: c.isNotNull()), 0)["s"]


def assign_sections(body: DataFrame) -> DataFrame:
    """body below the header with section and is_title. The row above the header that comes last names the opening section.

    A lone cell in between continues the last data row if the current section has the name of that row's, else it is a
    title too. As each title decides how the next lone cell is read, rows are scanned in order; only their kinds and
    lone cells go to Python."""
    pre = body.filter(F.col("kind") == ABOVE).groupBy("file").agg(F.max_by("value", "row_no").alias("opening"))
    body = body.filter(F.col("kind") != ABOVE)
    told = body.select("file", "row_no", "kind", "value").join(kept(pre), "file", "left").withColumn("opening", F.coalesce("opening", F.lit(DEFAULT_SECTION)))
    type_ = dict(body.dtypes)
    named = block_scan(told, Titles, f"file {type_['file']}, row_no {type_['row_no']}, section string, is_title boolean")
    return body.join(named, ["file", "row_no"])


def assign_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows: file, row_no, section, vals (aligned to the header) with titles and continuations resolved."""
    body = kept(body_rows(rows, headers))
    return rows_of_body(body, count_rows(body))


def rows_of_body(body: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """As assign_rows, of what body_rows and count_rows give.

    Leading blanks take what the row above has there, since the last title; a value is followed by the texts that
    continue it, and a row that inherits the value inherits them. Files of up to `block` rows are dealt once and go
    through one pass; only longer ones are cut into blocks."""
    type_ = dict(body.dtypes)
    long = kept(counts.filter(F.col("every") > block).select("file"))
    short = sheet_scan(body.join(long, "file", "left_anti"), DEFAULT_SECTION, f"file {type_['file']}, row_no {type_['row_no']}, section string, vals array<struct<s:string,n:double>>")
    if long.isEmpty():
        return short
    body = kept(assign_sections(body.join(long, "file", "left_semi")))
    kind = F.when(F.col("is_title"), HARD).otherwise(F.col("kind"))
    part = lambda c: F.transform("vals", lambda v: v[c]).alias(c)
    schema = f"file {type_['file']}, row_no {type_['row_no']}, section string, s array<string>, n array<double>"
    filled = block_scan(body.select("file", "row_no", "section", kind.alias("kind"), part("s"), part("n")), Values, schema, block)
    value = F.zip_with("s", "n", lambda s, n: F.when(s.isNotNull(), F.struct(s.alias("s"), n.alias("n"))))
    return short.unionByName(filled.select("file", "row_no", "section", value.alias("vals")))


def count_rows(body: DataFrame) -> DataFrame:
    """file, n and every: data rows and all rows of each file, before any of them is ordered."""
    return body.groupBy("file").agg(F.count_if(F.col("kind") == DATA).alias("n"), F.count("*").alias("every"))


def reject_files(rows: DataFrame, counts: DataFrame, headers: DataFrame, most: int | None = MAX_ROWS) -> DataFrame:
    """file, code: no_header_row, empty_sheet or too_many_rows (never, if most is None); counts: file, n."""
    files = rows.select("file").distinct().join(headers.select("file", F.lit(True).alias("headed")), "file", "left").join(counts.select("file", "n"), "file", "left")
    code = F.when(F.col("headed").isNull(), "no_header_row").when(F.col("n").isNull() | (F.col("n") == 0), "empty_sheet").when(F.lit(False) if most is None else F.col("n") > most, "too_many_rows")
    return files.select("file", code.alias("code")).filter(F.col("code").isNotNull())


def infer_types(data: DataFrame, columns: DataFrame, share: float = NUMBER_SHARE) -> DataFrame:
    """columns with type: number where at least `share` of the filled cells are numbers."""
    cell = data.select("file", F.posexplode("vals").alias("pos", "v")).filter(F.col("v").isNotNull())
    n = cell.groupBy("file", "pos").agg((F.count("v.n") / F.count("*")).alias("share"))
    return columns.join(n, ["file", "pos"], "left").select(*columns.columns, F.when(F.col("share") >= share, "number").otherwise("string").alias("type"))


def number_columns(columns: DataFrame) -> DataFrame:
    """file, numbers: places of the number columns of the files that have any."""
    return columns.filter(F.col("type") == "number").groupBy("file").agg(F.collect_list("pos").alias("numbers"))  # columns of one file


def told_separators(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of data rows with their file's numbers: (those with a value there, file and separators dropped)."""
    each = each.withColumn("_sep", F.col("numbers").isNotNull() & ~F.exists("numbers", lambda p: F.get("vals", p).isNotNull()))
    dropped = each.groupBy("file").agg(F.count_if("_sep").alias("separators"))
    return each.filter(~F.coalesce("_sep", F.lit(False))).drop("numbers", "_sep"), dropped


def drop_separators(data: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data rows with a value in some number column, file and separators dropped). Files without number columns keep all."""
    return told_separators(data.join(kept(number_columns(columns)), "file", "left"))


def identity_columns(columns: DataFrame) -> DataFrame:
    """file, identity: places of the columns that are no numbers, or of all if there are only numbers."""
    place = lambda kind: F.array_sort(F.collect_list(kind))
    a = columns.groupBy("file").agg(place(F.when(F.col("type") != "number", F.col("pos"))).alias("texts"), place(F.col("pos")).alias("every"))
    return a.select("file", F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.col("every")).alias("identity"))


def with_row_key(data: DataFrame) -> DataFrame:
    """Data rows with their file's identity, which becomes row_key: SHA-256 of section and identity values; null differs from text."""
    values = F.transform("identity", lambda p: F.get("vals", p)["s"])
    return data.withColumn("row_key", F.sha2(F.to_json(F.struct("section", values.alias("values"))), 256)).drop("identity")


def section_order(data: DataFrame) -> DataFrame:
    """file, sections: those that hold rows, in the order of their first row."""
    first = data.groupBy("file", "section").agg(F.min("row_no").alias("at"))
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda x: x["section"]).alias("sections"))


def forward_fill_leading(rows: DataFrame, columns: list[str], partition: list[str], order: str) -> DataFrame:
    """Wide form: leading blanks take the value above them, within the partition; other blanks stay and are inherited."""
    lead = F.coalesce(*[F.when(F.col(c).isNotNull(), i) for i, c in enumerate(columns)], F.lit(len(columns)))
    out = rows.withColumn("_lead", lead)
    w = Window.partitionBy(*partition).orderBy(order)
    for i, c in enumerate(columns):
        out = out.withColumn(f"_g{i}", F.sum(F.when(F.col("_lead") <= i, 1).otherwise(0)).over(w))
    for i, c in enumerate(columns):
        inner = Window.partitionBy(*partition, f"_g{i}").orderBy(order)
        out = out.withColumn(c, F.first(c).over(inner))
    # before the first group there is nothing to inherit
    for i, c in enumerate(columns):
        out = out.withColumn(c, F.when(F.col(f"_g{i}") > 0, F.col(c)))
    return out.drop("_lead", *[f"_g{i}" for i in range(len(columns))])


def load(grid: DataFrame, most: int | None = MAX_ROWS) -> dict[str, DataFrame]:
    """All steps: headers, columns (typed), data (keyed, without separators), separators, rejects.

    Files with too many rows are rejected by a count, before their rows are ordered; with most=None all are read."""
    rows = kept(normalise(grid))
    headers = kept(find_headers(rows))
    body = kept(body_rows(rows, headers))
    counts = kept(count_rows(body))
    rejects = kept(reject_files(rows, counts, headers, most))
    left = headers.join(rejects.select("file"), "file", "left_anti")
    # of the other rejects no row is data
    over = kept(rejects.filter(F.col("code") == "too_many_rows").select("file"))
    data = kept(rows_of_body(body.join(over, "file", "left_anti"), counts.join(over, "file", "left_anti")))
    columns = kept(infer_types(data, column_keys(headers)))
    # rows meet what is told of their file once, though several tables are read from them
    of_file = kept(identity_columns(columns).join(number_columns(columns), "file", "left"))
    data, separators = told_separators(kept(data.join(of_file, "file")))
    # a file of separators only is empty too
    empty = left.join(data.select("file").distinct(), "file", "left_anti").select("file", F.lit("empty_sheet").alias("code"))
    data = with_row_key(data)
    return {"headers": headers, "columns": columns, "data": data, "separators": separators, "rejects": rejects.unionByName(empty)}


def value_of(pos: int) -> Column:
    return F.get("vals", pos)["s"]
