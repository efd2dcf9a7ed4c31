"""From loaded sheets to the dashboard of each, for all sheets at once.

ingest.load gives rows with values by place; here they become cells, what their columns are for becomes a
table of roles (one row a sheet), and every summary reads rows by role, whatever each sheet calls its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import coverage as C
from gridledger.operators import dashboards as D
from gridledger.operators import facts as G
from gridledger.sources.kept import kept

ROW = ["snapshot_id", "section", "row_index"]


def cells_of(loaded: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, columns, n_rows) of what ingest.load gives; a file is a snapshot. Empty cells are left out."""
    data, columns = loaded["data"], loaded["columns"]
    each = data.select(F.col("file").alias("snapshot_id"), "section", F.col("row_no").alias("row_index"), F.posexplode("vals").alias("pos", "v")).filter(F.col("v").isNotNull())
    columns = columns.select(F.col("file").alias("snapshot_id"), "pos", "key", "label", "type")
    cells = each.join(columns.select("snapshot_id", "pos", "key", "type"), ["snapshot_id", "pos"]).select(*ROW, "pos", "key", F.col("v.s").alias("s"), F.col("v.n").alias("n"), "type")
    return cells, columns, data.groupBy(F.col("file").alias("snapshot_id")).agg(F.count("*").alias("n_rows"))


def roles(cells: DataFrame, columns: DataFrame, n_rows: DataFrame, requested: str | None = None) -> DataFrame:
    """One row for each snapshot: kind and reason of its dashboard, and the keys of its columns: passed, failed,
    not_run, total, status, measure, dimension, id_column, labels (keys whose texts name a row)."""
    stats = kept(D.column_stats(cells, columns))
    dims = kept(D.rank_dimensions(columns, stats, n_rows))
    # each part is kept, as one stage of all their joins needs more memory than its task has
    runs, status, inventory = kept(D.detect_run_columns(columns)), kept(D.detect_status_column(columns, stats, n_rows)), kept(D.detect_inventory(columns, stats))
    out = kept(D.classify(columns, stats, n_rows, runs, status, inventory)).join(n_rows, "snapshot_id")
    for part in (runs.drop("is_run"), status, D.primary_measure(columns)):
        out = out.join(part, "snapshot_id", "left")
    out = kept(out)
    for part in (inventory, D.choose_dimension(dims, requested), kept(D.label_columns(columns, dims, cells))):
        out = out.join(part, "snapshot_id", "left")
    return out


def rows_by_role(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """snapshot_id, section, row_index, kind, the numbers passed, failed, not_run, total, measure, the texts status and
    dimension, and label, of every row that has a filled cell. One grouping by row."""
    numbers, texts = ("passed", "failed", "not_run", "total", "measure"), ("status", "dimension")
    named = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("key"), F.lit(c).alias("role"), F.lit(0).alias("place"))) for c in (*numbers, *texts)]
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda k, i: F.struct(k.alias("key"), F.lit("label").alias("role"), i.alias("place")))
    used = roles.select("snapshot_id", F.inline(F.concat(F.array_compact(F.array(*named)), labels)))
    # cells without a role still say that the row is there
    got = cells.join(used, ["snapshot_id", "key"], "left")
    number = lambda c: F.max(F.when(F.col("role") == c, F.col("n"))).alias(c)
    text = lambda c: F.max(F.when(F.col("role") == c, F.col("s"))).alias(c)
    parts = F.array_sort(F.collect_list(F.when((F.col("role") == "label") & (F.trim("s") != ""), F.struct("place", "s"))))  # labels of one row
    out = got.groupBy(*ROW).agg(*[number(c) for c in numbers], *[text(c) for c in texts], F.array_join(F.transform(parts, lambda x: x["s"]), D.LABEL_SEPARATOR).alias("label"))
    return out.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "section")).join(roles.select("snapshot_id", "kind"), "snapshot_id")


def run_boards(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """snapshot_id and run_summary's figures of the sheets of run results; a sheet without a total column adds up its own."""
    runs = roles.filter(F.col("kind") == "run_results").select("snapshot_id", F.col("total").isNotNull().alias("_has_total"))
    sums = D.run_summary(rows.join(runs, "snapshot_id"), "passed", "failed", "not_run", "total", ("snapshot_id", "_has_total"))
    own = F.col("executed") + F.col("not_run")
    total = F.when(F.col("_has_total"), F.col("total")).otherwise(own)
    return sums.withColumns(D.run_shares(total, F.when(F.col("_has_total"), F.round(total - own, 2)).otherwise(F.lit(0.0)))).drop("_has_total")


def status_boards(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """snapshot_id, the status and measure columns, and status_summary's figures of the sheets with a status."""
    some = roles.filter(F.col("kind") == "status").select("snapshot_id", F.col("status").alias("status_key"), F.col("measure").alias("measure_key"))
    of = rows.join(some, "snapshot_id")
    amount = F.sum(F.when(F.col("measure_key").isNull(), 1.0).otherwise(F.coalesce("measure", F.lit(0.0))))
    each = of.filter(F.col("status").isNotNull()).groupBy("snapshot_id", F.col("status").alias("value")).agg(F.count("*").alias("n_rows"), amount.alias("measure"))
    return D.status_summary(each, ("snapshot_id",)).join(some.select("snapshot_id", F.col("status_key").alias("status"), F.col("measure_key").alias("measure")), "snapshot_id")


def dimension_boards(rows: DataFrame) -> DataFrame:
    """snapshot_id, value, n_rows, passed, failed, measure, rank, pass_rate of the values of each sheet's dimension."""
    out = D.dimension_breakdown(rows, "dimension", ["passed", "failed", "measure"], ("snapshot_id",))
    return out.withColumn("pass_rate", D.bucket_rate("passed", "failed"))


def row_lists(rows: DataFrame) -> DataFrame:
    """snapshot_id, list, rank, label, amount, status: the rows with most failures, the open rows, and the largest rows."""
    order = ["section", "row_index"]
    worst = D.failing_rows(rows.filter("kind = 'run_results'"), "failed", F.col("label"), order, ["failed", "rank"], by=("snapshot_id",))
    waiting = D.open_rows(rows.filter("kind = 'status'"), "status", F.col("label"), order, by=("snapshot_id",))
    top = D.top_rows(rows.filter("kind <> 'inventory'"), "measure", F.col("label"), order, ("snapshot_id",))
    none = F.lit(None)
    return (
        worst.select("snapshot_id", F.lit("failing").alias("list"), "rank", "label", F.col("failed").alias("amount"), none.cast("string").alias("status"))
        .unionByName(waiting.select("snapshot_id", F.lit("open").alias("list"), "rank", "label", none.cast("double").alias("amount"), "status"))
        .unionByName(top.select("snapshot_id", F.lit("largest").alias("list"), "rank", "label", F.col("measure").alias("amount"), none.cast("string").alias("status")))
    )


def _titles(cells: DataFrame, first: DataFrame) -> DataFrame:
    """snapshot_id, row_index, title (the second filled cell) of the first rows of entries."""
    own = cells.join(first.select("snapshot_id", "row_index"), ["snapshot_id", "row_index"], "left_semi").filter(F.trim("s") != "")
    listed = F.array_sort(F.collect_list(F.struct("pos", "s")))  # cells of one row
    return own.groupBy("snapshot_id", "row_index").agg(G.clip(F.get(listed, 1)["s"]).alias("title"))


def inventory_boards(cells: DataFrame, columns: DataFrame, roles: DataFrame, shown: int = D.LISTED) -> tuple[DataFrame, DataFrame]:
    """(summaries, lists) of the sheets that list identifiers.

    Summaries: snapshot_id, items, unreadable, duplicates, family, link_family, linked, unlinked, links, linked_pct.
    Lists: snapshot_id, kind (linked, unlinked), rank, display, links, title. The link family of a sheet is the one,
    other than its own, that most entries name, if at least two and a fourth of them do (ties: the smallest name)."""
    by = "snapshot_id"
    ids = roles.filter(F.col("kind") == "inventory").select(by, "id_column")
    own = cells.join(ids, by)
    place = own.groupBy(by, "row_index").agg(F.max(F.when(F.col("key") == F.col("id_column"), F.col("s"))).alias("cell"))
    read = C.with_identifier(place, "cell")
    entries = kept(read.groupBy(by, "key").agg(F.min("row_index").alias("row_index"), F.min_by("display", "row_index").alias("display"), F.min_by("family", "row_index").alias("family"), F.count("*").alias("n_rows")))
    good = F.col("key").isNotNull()
    first = entries.filter(good)

    texts = columns.filter(F.col("type") == "string").select(by, F.col("key").alias("column"))
    named = own.withColumnRenamed("key", "column").join(texts, [by, "column"], "left_semi").join(first.select(by, "row_index", "key"), [by, "row_index"])
    named = named.filter(F.col("s").rlike(r"\d")).select(by, "key", (F.col("column") == F.col("id_column")).alias("is_id"), F.posexplode(T.tokens("s")).alias("token_no", "token"))
    named = named.filter(~(F.col("is_id") & (F.col("token_no") == 0)) & ~F.lower(F.regexp_extract("token", "^[A-Za-z]+", 0)).isin(*T.MONTHS))
    links = kept(named.select(by, "key", T.canonical("token").alias("canon"), T.family_of("token").alias("token_family")).filter("token_family <> ''").distinct())

    items = entries.groupBy(by).agg(F.count_if(good).alias("items"), F.coalesce(F.sum(F.when(~good, F.col("n_rows"))), F.lit(0)).alias("unreadable"), F.coalesce(F.sum(F.when(good, F.col("n_rows") - 1)), F.lit(0)).alias("duplicates"))
    fam = first.filter("family <> ''").groupBy(by, "family").agg(F.count("*").alias("n"), F.min("row_index").alias("at"))
    fam = fam.groupBy(by).agg(F.max_by("family", F.struct("n", -F.col("at"))).alias("family"))
    per = links.groupBy(by, "token_family").agg(F.count_distinct("key").alias("linked"), F.count("*").alias("links")).join(items.select(by, "items"), by).join(fam, by, "left")
    per = per.filter(~F.col("token_family").eqNullSafe(F.col("family")) & (F.col("linked") >= D.LINK_ENTRIES) & (F.col("linked") >= D.LINK_SHARE * F.col("items")))
    best = per.groupBy(by).agg(F.min(F.struct((-F.col("linked")).alias("w"), "token_family", "links")).alias("b"))
    best = best.select(by, F.col("b.token_family").alias("link_family"), (-F.col("b.w")).alias("linked"), F.col("b.links").alias("links"))
    zero, some = F.lit(0).cast("long"), F.col("link_family").isNotNull()
    summary = items.join(fam, by, "left").join(best, by, "left").select(
        by, "items", "unreadable", "duplicates", F.coalesce("family", F.lit("")).alias("family"), F.coalesce("link_family", F.lit("")).alias("link_family"),
        F.coalesce("linked", zero).alias("linked"), F.when(some, F.col("items") - F.col("linked")).otherwise(zero).alias("unlinked"), F.coalesce("links", zero).alias("links"),
        F.when(some, F.round(F.col("linked") / F.col("items") * 100, 1)).alias("linked_pct"))

    n = links.join(best.select(by, F.col("link_family").alias("token_family")), [by, "token_family"]).groupBy(by, "key").agg(F.count("*").alias("links"))
    each = first.join(best.select(by), by, "left_semi").join(n, [by, "key"], "left").withColumn("links", F.coalesce("links", zero))
    kind = F.when(F.col("links") > 0, "linked").otherwise("unlinked")
    w = Window.partitionBy(by, "kind").orderBy(F.col("links").desc(), "row_index")
    listed = kept(each.withColumn("kind", kind).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= shown).select(by, "kind", "rank", "row_index", "display", "links"))
    titles = _titles(cells, listed)
    return summary, listed.join(titles, [by, "row_index"], "left").select(by, "kind", "rank", "display", "links", F.coalesce("title", F.lit("")).alias("title"))


def boards(loaded: dict[str, DataFrame], requested: str | None = None) -> dict[str, DataFrame]:
    """Everything that the dashboards of all loaded sheets show, by name; each table has a snapshot_id."""
    cells, columns, n_rows = (kept(x) for x in cells_of(loaded))
    found = kept(roles(cells, columns, n_rows, requested))
    rows = kept(rows_by_role(cells, found))
    inventory, entries = inventory_boards(cells, columns, found)
    numbers = columns.filter(F.col("type") == "number").select("snapshot_id", "key")
    totals = cells.join(numbers, ["snapshot_id", "key"]).groupBy("snapshot_id", "section", "key").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    return {
        "cells": cells, "columns": columns, "n_rows": n_rows, "roles": found, "rows": rows, "section_totals": totals,
        "run_results": run_boards(rows, found), "status": status_boards(rows, found), "inventory": inventory, "entries": entries,
        "dimensions": dimension_boards(rows), "lists": row_lists(rows),
    }


def figures(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each sheet: kind, reason, rows, and the figures of whichever dashboard it has."""
    run = parts["run_results"].select("snapshot_id", F.struct("passed", "failed", "not_run", "total", "executed", "unaccounted", "pass_rate_pct", "executed_pct", "reconciles").alias("run"))
    status = parts["status"].select("snapshot_id", F.struct("passed", "failed", "pending", "unrecognised", "decided", "total", "pass_rate_pct", "statuses").alias("state"))
    inventory = parts["inventory"].select("snapshot_id", F.struct("items", "unreadable", "duplicates", "family", "link_family", "linked", "unlinked", "links", "linked_pct").alias("listed"))
    out = parts["roles"].select("snapshot_id", "kind", "reason", "n_rows", "measure", "dimension")
    for t in (run, status, inventory):
        out = out.join(kept(t), "snapshot_id", "left")
    return out


