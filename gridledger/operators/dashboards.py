"""Dashboards of many snapshots at once.

Two shapes of input: *wide* rows with named columns, and *cells* (snapshot_id, section, row_index, pos,
key, s, n) for files that share no columns. `columns` is (snapshot_id, pos, key, label, type), and
`stats` what column_stats gives: (snapshot_id, key, distinct, filled, outcomes, identifiers, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.sources.kept import kept

# Fixed values that results depend on.
PASS_LABEL = r"(?i)\bpass(ed)?\b"
FAIL_LABEL = r"(?i)\bfail(ed|ure|ures)?\b"
NOT_RUN_LABEL = r"(?i)\bn\.?\s*/?\s*a\b|not\s*applicable|\bskip(ped)?\b|\bblocked\b|\bnot\s*run\b"
TOTAL_LABEL = r"(?i)test\s*count|test\s*cases|\btotal\b|\bcount\b"
STATUS_LABEL = r"(?i)\bstatus\b|\bresult\b|\bstate\b|\boutcome\b|\bverdict\b"
PERCENT_LABEL = r"(?i)%|\bpercent|\brate\b"
SERIAL_LABEL = r"(?i)\b(no|nos|num|number|s\.?\s*no|sr|serial)\.?\s*$|^#"
OUTCOME_SHARE, STATUS_FILLED, IDENTIFIER_SHARE = 0.5, 0.5, 0.5
DIMENSION_VALUES = (2, 12)
TEXT_COLUMNS, SAMPLE_VALUES, TOP, OPEN, LISTED = 16, 25, 10, 20, 20
LINK_ENTRIES, LINK_SHARE = 2, 0.25
LABEL_SEPARATOR = " · "


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, 1))


def section_totals(rows: DataFrame, section: str, measures: list[str]) -> DataFrame:
    """Rows and measure sums for each section, and one row for all (is_total)."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    return rows.rollup(section).agg(F.grouping(section).cast("int").alias("is_total"), F.count("*").alias("n_rows"), *sums)


def top_rows(rows: DataFrame, measure: str, label: Column, order: list[str], by: tuple[str, ...] = (), k: int = TOP) -> DataFrame:
    """The k rows of largest measure for each `by`; ties by `order`."""
    w = Window.partitionBy(*by).orderBy(F.col(measure).desc(), *order)
    kept = rows.filter(F.col(measure).isNotNull())
    if not by:  # a global limit keeps k rows for each task
        kept = kept.orderBy(F.col(measure).desc(), *order).limit(k)
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, "rank", label.alias("label"), measure)


def row_label(columns: list[str], section: str) -> Column:
    """The filled texts joined, else the section."""
    joined = F.concat_ws(LABEL_SEPARATOR, *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])
    return F.coalesce(F.nullif(joined, F.lit("")), F.col(section))


def merged_dashboard(cells: DataFrame, columns: DataFrame, current: DataFrame) -> DataFrame:
    """section, measure, total over the current snapshots, with measures of one meaning folded together.

    is_shared: every current file has the measure. Works on cells, so files need no common columns. A layer of
    one file answers as that file does: none of its columns is folded."""
    fold = folded_measures(columns, current)
    shared = fold.groupBy("measure").agg(F.count_distinct("snapshot_id").alias("files"), F.max("all_files").alias("all_files"))
    each = cells.groupBy("snapshot_id", "section", "key").agg(F.sum("n").alias("n"))  # summed before it meets the columns' roles
    sums = each.join(fold, ["snapshot_id", "key"]).groupBy("section", "measure").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return sums.join(shared, "measure").select("section", "measure", "total", (F.col("files") == F.col("all_files")).alias("is_shared"))


def folded_measures(columns: DataFrame, current: DataFrame) -> DataFrame:
    """snapshot_id, pos, key, measure, all_files of the number columns of the current snapshots."""
    files = current.agg(F.count_distinct("snapshot_id").alias("all_files"))
    fold = columns.filter(F.col("type") == "number").join(current.select("snapshot_id"), "snapshot_id", "left_semi").crossJoin(files)  # files: one row
    measure = F.when(F.col("all_files") > 1, T.measure_identity("label", "key")).otherwise(F.col("key"))
    return fold.select("snapshot_id", "pos", "key", measure.alias("measure"), "all_files")


def merged_top_rows(cells: DataFrame, columns: DataFrame, current: DataFrame, k: int = TOP) -> DataFrame:
    """snapshot_id, section, row_index, measure, value, rank, label: the largest rows over all current files, by the
    rightmost measure that every file has; none if they share no measure. Rows are named by their filled texts.

    Rightmost: that which comes last when files are read newest first and columns from the left, each measure at
    its first place. current: snapshot_id, created_at."""
    order = current.select("snapshot_id", F.row_number().over(Window.orderBy(F.col("created_at").desc(), "snapshot_id")).alias("file_no"))  # current files of one layer
    fold = folded_measures(columns, current).join(order, "snapshot_id")
    per = fold.groupBy("measure").agg(F.count_distinct("snapshot_id").alias("files"), F.max("all_files").alias("all_files"), F.min(F.struct("file_no", "pos")).alias("at"))
    best = per.filter("files = all_files").agg(F.max_by("measure", "at").alias("measure"))  # one row
    used = fold.join(F.broadcast(best), "measure").select("snapshot_id", "key", "measure")
    rows = cells.filter(F.col("n").isNotNull()).join(F.broadcast(used), ["snapshot_id", "key"])  # a row a current file of one layer; cells stay where they are
    place = ["snapshot_id", "section", "row_index"]
    first = rows.orderBy(F.col("n").desc(), *place).limit(k)
    first = kept(first.select(*place, "measure", F.col("n").alias("value")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), *place))))  # k rows
    texts = columns.filter(F.col("type") == "string").select("snapshot_id", "key")
    own = cells.join(F.broadcast(first.select(*place)), place, "left_semi").filter(F.trim("s") != "").join(texts, ["snapshot_id", "key"], "left_semi")  # cells of k rows meet the columns
    label = own.groupBy(*place).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), LABEL_SEPARATOR).alias("label"))
    return first.join(label, place, "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "section"))


def cells_of(rows: DataFrame, snapshot: Column, section: str, order: str, texts: list[str], numbers: list[str]) -> DataFrame:
    """Wide rows as cells, with the type of their column."""
    items = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("key"), F.col(c).cast("string").alias("s"), (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("n"), F.lit("number" if c in numbers else "string").alias("type")) for i, c in enumerate([*texts, *numbers])]
    return rows.select(snapshot.alias("snapshot_id"), F.col(section).alias("section"), F.col(order).alias("row_index"), F.explode(F.array(*items)).alias("c")).select("snapshot_id", "section", "row_index", "c.*")


def column_stats(cells: DataFrame, columns: DataFrame, most: int = TEXT_COLUMNS, sample: int = SAMPLE_VALUES) -> DataFrame:
    """Of each snapshot's first text columns: distinct, filled, how many of the distinct values are status words
    (outcomes) or read as identifiers, and the first `sample` values.

    One grouping for all columns. Values are judged one by one and then counted, so all of them decide; they are
    listed only up to the sample, for display. Cells meet the table of columns only when each column is one row, so a
    column's values are the work of many tasks; cells that know their column's type leave out numbers before that."""
    rank = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("pos"))
    texts = columns.filter(F.col("type") == "string").withColumn("_r", rank).filter(F.col("_r") <= most).select("snapshot_id", "key")
    values = _of_texts(cells).filter(F.trim("s") != "").groupBy("snapshot_id", "key", "s").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("snapshot_id", "key").orderBy("s"))
    outcome, identifier = F.count_if(T.outcome_of("s") != "").alias("outcomes"), F.count_if(T.is_identifier("s")).alias("identifiers")
    each = values.groupBy("snapshot_id", "key").agg(F.count("*").alias("distinct"), F.sum("n").alias("filled"), outcome, identifier)
    shown = values.withColumn("_r", first).filter(F.col("_r") <= sample).groupBy("snapshot_id", "key").agg(F.array_sort(F.collect_list("s")).alias("values"))
    return each.join(texts, ["snapshot_id", "key"], "left_semi").join(shown, ["snapshot_id", "key"])


def _of_texts(cells: DataFrame) -> DataFrame:
    """cells of text columns, if they have their column's type; else all."""
    return cells.filter(F.col("type") == "string") if "type" in cells.columns else cells


def detect_run_columns(columns: DataFrame) -> DataFrame:
    """snapshot_id with the keys of its passed, failed, not_run and total columns; a column has one role."""
    left = columns.filter(F.col("type") == "number")
    out = columns.select("snapshot_id").distinct()
    for role, pattern in (("passed", PASS_LABEL), ("failed", FAIL_LABEL), ("not_run", NOT_RUN_LABEL), ("total", TOTAL_LABEL)):
        hit = kept(left.filter(F.col("label").rlike(pattern)).groupBy("snapshot_id").agg(F.min_by("key", "pos").alias(role)))  # read by two joins of each later role
        out = out.join(hit, "snapshot_id", "left")
        left = left.join(hit, "snapshot_id", "left").filter(~F.col("key").eqNullSafe(F.col(role))).drop(role)
    return out.withColumn("is_run", F.col("passed").isNotNull() & (F.col("failed").isNotNull() | F.col("total").isNotNull()))


def run_summary(rows: DataFrame, passed: str, failed: str | None, not_run: str | None, total: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums, pass rate over what was executed, executed share of the total, and whether the total adds up."""
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double") if c else F.lit(0.0)
    a = rows.groupBy(*by).agg(of(passed).alias("passed"), of(failed).alias("failed"), of(not_run).alias("not_run"), *([of(total).alias("total")] if total else []))
    a = a.withColumn("executed", F.col("passed") + F.col("failed"))
    own = F.col("executed") + F.col("not_run")
    return a.withColumns(run_shares(F.col("total") if total else own, F.round(F.col("total") - own, 2) if total else F.lit(0.0)))


def run_shares(total: Column, unaccounted: Column) -> dict[str, Column]:
    """total, unaccounted and what follows from them, for rows with passed and executed."""
    return {"total": total, "unaccounted": unaccounted, "pass_rate_pct": _pct(F.col("passed"), F.col("executed")), "executed_pct": _pct(F.col("executed"), total), "reconciles": F.abs(unaccounted) < 0.5}


def detect_status_column(columns: DataFrame, stats: DataFrame, n_rows: DataFrame) -> DataFrame:
    """snapshot_id, status: the text column half of whose distinct values read as outcomes; n_rows: snapshot_id, n_rows."""
    each = columns.filter(F.col("type") == "string").join(stats, ["snapshot_id", "key"]).join(n_rows, "snapshot_id")
    each = each.withColumn("share", F.col("outcomes") / F.col("distinct")).filter((F.col("share") >= OUTCOME_SHARE) & (F.col("filled") >= STATUS_FILLED * F.col("n_rows")))
    rank = F.struct(F.col("label").rlike(STATUS_LABEL), "share", -F.col("distinct"), -F.col("pos"))
    return each.groupBy("snapshot_id").agg(F.max_by("key", rank).alias("status"))


def primary_measure(columns: DataFrame) -> DataFrame:
    """snapshot_id, measure: the rightmost number column that is no percentage and no serial number."""
    usable = columns.filter((F.col("type") == "number") & ~F.col("label").rlike(PERCENT_LABEL) & ~F.col("label").rlike(SERIAL_LABEL))
    return usable.groupBy("snapshot_id").agg(F.max_by("key", "pos").alias("measure"))


def status_breakdown(rows: DataFrame, status: str, measure: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and measure for each status value."""
    amount = F.coalesce(F.sum(measure), F.lit(0)) if measure else F.count("*")
    return rows.filter(F.col(status).isNotNull()).groupBy(*by, F.col(status).alias("value")).agg(F.count("*").alias("n_rows"), amount.cast("double").alias("measure"))


def status_summary(breakdown: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """passed, failed, pending, unrecognised, decided, total, pass rate over what was decided, and the statuses by weight."""
    each = breakdown.withColumn("kind", T.outcome_of("value"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("measure"))), F.lit(0.0))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("measure")).alias("w"), (-F.col("n_rows")).alias("r"), "value")))  # status words of one sheet
    a = each.groupBy(*by).agg(of("passing").alias("passed"), of("failing").alias("failed"), of("pending").alias("pending"), of("").alias("unrecognised"), F.sum("measure").alias("total"), F.sum("n_rows").alias("n_rows"), F.array_join(F.transform(listed, lambda x: x["value"]), ",").alias("statuses"))
    return a.withColumn("decided", F.col("passed") + F.col("failed")).withColumn("pass_rate_pct", _pct(F.col("passed"), F.col("decided")))


def rank_dimensions(columns: DataFrame, stats: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Text columns with a handful of repeated values, richest first, then by label: snapshot_id, key, distinct, rank."""
    low, high = DIMENSION_VALUES
    each = columns.filter(F.col("type") == "string").join(stats.select("snapshot_id", "key", "distinct"), ["snapshot_id", "key"]).join(n_rows, "snapshot_id")
    each = each.filter(F.col("distinct").between(low, high) & (F.col("distinct") < F.col("n_rows")))
    return each.select("snapshot_id", "key", "distinct", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.col("distinct").desc(), "label")).alias("rank"))


def choose_dimension(dimensions: DataFrame, requested: str | None) -> DataFrame:
    """snapshot_id, dimension: the requested one where it exists, else the first."""
    asked = F.max(F.when(F.col("key") == F.lit(requested), F.col("key")))
    return dimensions.groupBy("snapshot_id").agg(F.coalesce(asked, F.min_by("key", "rank")).alias("dimension"))


def dimension_breakdown(rows: DataFrame, dimension: str, measures: list[str], by: tuple[str, ...] = (), k: int = DIMENSION_VALUES[1]) -> DataFrame:
    """Rows and sums for each value, the k with most rows."""
    each = rows.filter(F.col(dimension).isNotNull()).groupBy(*by, F.col(dimension).alias("value")).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(m), F.lit(0)).cast("double").alias(m) for m in measures])
    w = Window.partitionBy(*by).orderBy(F.col("n_rows").desc(), "value")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bucket_rate(passed: str, failed: str) -> Column:
    """Pass rate of a bucket over what it executed."""
    return _pct(F.col(passed), F.col(passed) + F.col(failed))


def failing_rows(rows: DataFrame, failed: str, label: Column, order: list[str], show: list[str], k: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """The k rows with most failures, of each `by` if that is given (with their rank)."""
    worst = rows.filter(F.col(failed) > 0)
    if not by:
        return worst.orderBy(F.col(failed).desc(), *order).limit(k).select(label.alias("label"), *show)
    w = Window.partitionBy(*by).orderBy(F.col(failed).desc(), *order)
    return worst.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, label.alias("label"), *show)


def open_rows(rows: DataFrame, status: str, label: Column, order: list[str], k: int = OPEN, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows whose status is failing or pending, of each `by` if that is given (with their rank)."""
    kind = T.outcome_of(status)
    found = rows.filter(kind.isin("failing", "pending"))
    shown = [label.alias("label"), F.col(status).alias("status"), kind.alias("kind")]
    if not by:
        return found.orderBy(*order).limit(k).select(*shown)
    w = Window.partitionBy(*by).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, "rank", *shown)


def label_columns(columns: DataFrame, dimensions: DataFrame, cells: DataFrame) -> DataFrame:
    """snapshot_id, labels: the serial column (else the first text column) and the first two dimensions; if these are
    fewer than two, the column with the longest texts as well."""
    serial = columns.filter(F.col("label").rlike(SERIAL_LABEL)).groupBy("snapshot_id").agg(F.min_by("key", "pos").alias("serial"))
    first = columns.filter(F.col("type") == "string").groupBy("snapshot_id").agg(F.min_by("key", "pos").alias("first"))
    dims = dimensions.filter(F.col("rank") <= 2).groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("dims"))
    texts = columns.filter(F.col("type") == "string").select("snapshot_id", "key")
    sizes = _of_texts(cells).groupBy("snapshot_id", "key").agg(F.avg(F.length("s")).alias("size"))  # a row a column, before it meets the columns
    long = sizes.join(texts, ["snapshot_id", "key"], "left_semi").groupBy("snapshot_id").agg(F.max_by("key", F.struct("size", "key")).alias("longest"))
    all_ = columns.select("snapshot_id").distinct().join(serial, "snapshot_id", "left").join(first, "snapshot_id", "left").join(dims, "snapshot_id", "left").join(long, "snapshot_id", "left")
    some = F.array_distinct(F.array_compact(F.concat(F.array(F.coalesce("serial", "first")), F.coalesce("dims", F.array().cast("array<string>")))))
    return all_.select("snapshot_id", F.when(F.size(some) < 2, F.array_distinct(F.array_compact(F.concat(some, F.array("longest"))))).otherwise(some).alias("labels"))


def detect_inventory(columns: DataFrame, stats: DataFrame) -> DataFrame:
    """snapshot_id, id_column where the first column is text and half of its distinct values read as identifiers."""
    first = columns.groupBy("snapshot_id").agg(F.min_by(F.struct("key", "type"), "pos").alias("c")).select("snapshot_id", "c.key", "c.type").filter(F.col("type") == "string")
    return first.join(stats, ["snapshot_id", "key"]).filter(F.col("identifiers") / F.col("distinct") >= IDENTIFIER_SHARE).select("snapshot_id", F.col("key").alias("id_column"))


def classify(columns: DataFrame, stats: DataFrame, n_rows: DataFrame, runs: DataFrame | None = None, status: DataFrame | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """snapshot_id, kind (run_results, status, inventory only without a measure, or volume) and the reason, which
    names the columns that decide. runs, status, inventory: what the detect_ functions give, if it is there already."""
    out = (detect_run_columns(columns) if runs is None else runs).select("snapshot_id", "is_run", F.col("passed").alias("_p"), F.coalesce("failed", "total").alias("_f"))
    status = detect_status_column(columns, stats, n_rows) if status is None else status
    inventory = detect_inventory(columns, stats) if inventory is None else inventory
    out = out.join(status, "snapshot_id", "left").join(primary_measure(columns), "snapshot_id", "left").join(inventory, "snapshot_id", "left")
    is_status, is_list = F.col("status").isNotNull(), F.col("measure").isNull() & F.col("id_column").isNotNull()
    kind = F.when(F.col("is_run"), "run_results").when(is_status, "status").when(is_list, "inventory").otherwise("volume")
    labels = columns.groupBy("snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "label"))).alias("_labels"))  # columns of one file
    quoted = lambda c: F.concat(F.lit("“"), F.element_at("_labels", F.col(c)), F.lit("”"))
    reason = (
        F.when(F.col("is_run"), F.concat(F.lit("columns "), quoted("_p"), F.lit(" and "), quoted("_f"), F.lit(" count outcomes")))
        .when(is_status, F.concat(F.lit("column "), quoted("status"), F.lit(" holds an outcome for each row")))
        .when(is_list, F.concat(F.lit("column "), quoted("id_column"), F.lit(" lists identifiers and nothing can be counted")))
        .otherwise("no column holds outcomes")
    )
    return out.join(labels, "snapshot_id").select("snapshot_id", kind.alias("kind"), reason.alias("reason"))


def inventory_entries(rows: DataFrame, texts: list[str], id_column: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(entries: key, display, order of each identifier's first row and how many rows it has, with key null for
    unreadable rows; links: key, canon, token_family)."""
    from gridledger.operators import coverage as C

    read = C.with_identifier(rows, id_column)
    entries = read.groupBy("key").agg(F.min(order).alias(order), F.min_by("display", order).alias("display"), F.count("*").alias("n_rows"))
    first = read.join(entries.filter(F.col("key").isNotNull()).select("key", order), ["key", order], "left_semi")
    named = C.mentioned(first, texts, id_column, ["key"], order)
    month = F.lower(F.regexp_extract("token", "^[A-Za-z]+", 0)).isin(*T.MONTHS)
    return entries, named.filter(~month).select("key", "canon", "token_family").distinct()


def inventory_summary(rows: DataFrame, texts: list[str], id_column: str, order: str) -> DataFrame:
    """One row: items, unreadable, duplicates, family, link family, linked, unlinked, links, linked_pct.

    Entries and links are kept, as several sums are taken of them."""
    entries, links = (kept(x) for x in inventory_entries(rows, texts, id_column, order))
    read = F.col("key").isNotNull()
    items = entries.agg(F.count_if(read).alias("items"), F.coalesce(F.sum(F.when(~read, F.col("n_rows"))), F.lit(0)).alias("unreadable"), F.coalesce(F.sum(F.when(read, F.col("n_rows") - 1)), F.lit(0)).alias("duplicates"))
    fam = entries.withColumn("family", T.family_of("display")).filter(F.col("family") != "").groupBy("family").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    fam = fam.groupBy().agg(F.min(F.struct(-F.col("n"), "at", "family"))["family"].alias("family"))
    per = links.filter(F.col("token_family") != "").groupBy("token_family").agg(F.count_distinct("key").alias("linked"), F.count("*").alias("links"))
    per = per.crossJoin(fam).crossJoin(items.select("items")).filter(~F.col("token_family").eqNullSafe(F.col("family")))  # fam, items: one row
    per = per.filter((F.col("linked") >= LINK_ENTRIES) & (F.col("linked") >= LINK_SHARE * F.col("items")))
    best = per.groupBy().agg(F.min(F.struct(-F.col("linked"), "token_family", "links")).alias("b"))
    none = F.lit(0).cast("long")
    one = items.crossJoin(fam).crossJoin(best)  # one row each
    one = one.withColumns({"link_family": F.coalesce("b.token_family", F.lit("")), "linked": F.coalesce(-F.col("b.col1"), none), "links": F.coalesce("b.links", none)})
    some = F.col("link_family") != ""
    return one.select(
        "items", "unreadable", "duplicates", F.coalesce("family", F.lit("")).alias("family"), "link_family",
        "linked", F.when(some, F.col("items") - F.col("linked")).otherwise(none).alias("unlinked"), "links", F.when(some, _pct(F.col("linked"), F.col("items"))).alias("linked_pct"),
    )


def inventory_lists(rows: DataFrame, texts: list[str], id_column: str, order: str, link_family: str, k: int = LISTED) -> DataFrame:
    """kind, display, links: the k entries with most links of a family, and the first k without any."""
    entries, links = inventory_entries(rows, texts, id_column, order)
    n = links.filter(F.col("token_family") == link_family).groupBy("key").agg(F.count("*").alias("links"))
    each = kept(entries.filter(F.col("key").isNotNull()).join(n, "key", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long"))))
    most = each.filter("links > 0").orderBy(F.col("links").desc(), "display").limit(k).select(F.lit("linked").alias("kind"), "display", "links")
    return most.unionByName(each.filter("links = 0").orderBy(order).limit(k).select(F.lit("unlinked").alias("kind"), "display", "links"))


def grams_of(text: Column) -> Column:
    """The different runs of three letters of a lower-cased text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))


def search_postings(rows: DataFrame, texts: list[str], key: str) -> DataFrame:
    """column, gram, key: which runs of three letters each text of each row holds, once; for searches to come."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("_text")) for c in texts]))
    long = rows.select(F.col(key), each).filter(F.length("_text") >= 3)
    return long.select("column", F.explode(grams_of(F.col("_text"))).alias("gram"), F.col(key))


def search_candidates(postings: DataFrame, query: str, key: str) -> DataFrame | None:
    """key of the rows of which some text holds every run of the query; None for a query of under three letters.

    Only the postings of the query's runs are read, and counted by row and text."""
    low = query.lower()
    runs = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not runs:
        return None
    held = postings.filter(F.col("gram").isin(runs)).groupBy(key, "column").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") == len(runs)).select(key).distinct()


def search_indexed(rows: DataFrame, postings: DataFrame, query: str, key: str, **how) -> DataFrame:
    """As search_records, whose arguments `how` are, by the postings of the section and the texts: only rows that may
    hold the query, or equal it in a number, are looked at. A query of under three letters scans."""
    found = search_candidates(postings, query, key)
    if found is not None:
        numbers = [F.col(c) == F.lit(query).try_cast("double") for c in how["numbers"]]
        equal = rows.filter(T.any_of([F.coalesce(h, F.lit(False)) for h in numbers])).select(key) if numbers else found.limit(0)
        rows = rows.join(found.union(equal).distinct(), key, "left_semi")
    return search_records(rows, query, **how)


def search_records(rows: DataFrame, query: str, section: str, texts: list[str], numbers: list[str], order: list[str], page: int = 1, size: int = 250, within: str | None = None) -> DataFrame:
    """One page of rows that hold the query in a text (any case, literally) or equal it in a number; n_total on each row."""
    word = F.lower(F.lit(query))
    hits = [F.contains(F.lower(F.col(c)), word) for c in [section, *texts]] + [F.col(c) == F.lit(query).try_cast("double") for c in numbers]
    found = rows.filter(T.any_of([F.coalesce(h, F.lit(False)) for h in hits]))
    if within is not None:
        found = found.filter(F.col(section) == within)
    total = found.agg(F.count("*").alias("n_total"))
    size = min(size, 500)
    return found.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(total)  # total: one row
