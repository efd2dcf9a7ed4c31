"""Coverage of one side's identifiers by another, in both directions.

Every side is a DataFrame of rows with the columns that the arguments name. Each is aggregated to one
row for each key before it meets the other side, so the join is one to one whatever a key's share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import cuts

MAX_RELATED = 20
GATHER_RELATED = 60
NUMERIC_KEYS = 0.9
IDENTIFIER_SHARE = 0.5
MISMATCH_SHARE = 0.5
SNIPPET = 70


def with_identifier(rows: DataFrame, id_column: str, pattern: str | None = None, override: str | None = None) -> DataFrame:
    """rows with key, display and family read from their identifier column (or an override where it is filled)."""
    cell = F.coalesce(F.col(override), F.col(id_column)) if override else F.col(id_column)
    if T.checked_pattern(pattern) is None:
        # as read_identifier, but step by step in columns of their own, which stay in generated code
        short = (F.length("_cell") <= T.MAX_ID_LENGTH) & F.col("_cell").rlike(r"(?U)\d")
        read = rows.withColumn("_cell", T.clean(cell)).withColumn("_first", T.first_token("_cell"))
        read = read.withColumn("display", F.coalesce("_first", F.when(short, F.col("_cell")))).drop("_cell", "_first")
        return read.withColumns({"key": T.canonical("display"), "family": T.family_of("display")}).select(*[c for c in rows.columns if c not in ("key", "display", "family")], "key", "display", "family")
    got = T.read_identifier(cell, pattern)
    return rows.withColumn("_id", got).withColumns({"key": F.col("_id.key"), "display": F.col("_id.display"), "family": F.col("_id.family")}).drop("_id")


def side_rows(cells: DataFrame, columns: DataFrame, pattern: str | None = None, override: str | None = None) -> DataFrame:
    """snapshot_id, section, row_index, id_column, cell, key, display, family of every row of a side.

    The identifier is read from the first column of the row's own file, or from the override's column in files that
    have it. cells: snapshot_id, section, row_index, key, s; columns: snapshot_id, pos, key."""
    own = F.min_by("key", "pos")
    if override:
        own = F.coalesce(F.max(F.when(F.col("key") == F.lit(override), F.col("key"))), own)
    ids = columns.groupBy("snapshot_id").agg(own.alias("id_column"))
    place = ["snapshot_id", "section", "row_index"]
    named = cells.join(ids, "snapshot_id").groupBy(*place, "id_column").agg(F.max(F.when(F.col("key") == F.col("id_column"), F.col("s"))).alias("cell"))
    return with_identifier(named, "cell", pattern)


def layer_rows(records: DataFrame, current: DataFrame, layer: str) -> DataFrame:
    """Rows of the current snapshots of a layer's files."""
    return records.join(current.filter(F.col("layer") == layer).select("snapshot_id"), "snapshot_id", "left_semi")


def occurrence_blocks(rows: DataFrame, partition: list[str], order: str, span: int | None = None) -> DataFrame:
    """rows with `starts`: 1 where a run of one key begins; repeats that follow each other count once.

    span: partitions are cut into ranges of so many numbers of the order, for sections of very many rows."""
    if span is None:
        rows = rows.withColumn("_before", F.lag("key").over(Window.partitionBy(*partition).orderBy(order)))
    else:
        rows = cuts.previous(rows, partition, order, "key", "_before", span)
    return rows.withColumn("starts", F.when(F.col("key").isNotNull() & ~F.col("key").eqNullSafe(F.col("_before")), 1).otherwise(0)).drop("_before")


def side_keys(rows: DataFrame, partition: list[str], order: str, span: int | None = None) -> DataFrame:
    """One row for each key: display and family of its first row, rows, blocks. span: as in occurrence_blocks."""
    place = F.struct(*partition, order)
    blocks = occurrence_blocks(rows, partition, order, span).filter(F.col("key").isNotNull())
    return blocks.groupBy("key").agg(
        F.min_by("display", place).alias("display"), F.min_by("family", place).alias("family"),
        F.count("*").alias("n_rows"), F.sum("starts").alias("blocks"), F.min(place).alias("first_at"),
    )


def dominant_family(rows: DataFrame, partition: list[str], order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each side of `by`): the family that most read rows carry (no family counts as one); on ties the first seen."""
    place = F.struct(*partition, order)
    each = rows.filter(F.col("key").isNotNull()).groupBy(*by, "family").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    return each.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "at", "family"))["family"].alias("family"))


def numeric_ratio(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """numeric_ratio (share of identifiers without a family, to 3 places) and occurrences, of each side of `by`."""
    bare = F.when(F.col("key").isNotNull(), F.when(F.col("family") == "", 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.avg(bare), F.lit(0.0)), 3).alias("numeric_ratio"), F.count("key").alias("occurrences"))


def describe_sides(rows: DataFrame, partition: list[str], order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., family, numeric_ratio, occurrences: what coverage_warnings reads of a side."""
    ratio, family = numeric_ratio(rows, by), dominant_family(rows, partition, order, by)
    both = ratio.join(family, list(by), "left") if by else ratio.crossJoin(family)  # one row each
    return both.withColumn("family", F.coalesce("family", F.lit("")))


def section_ids(rows: DataFrame, section: str, family: DataFrame, keys: DataFrame) -> DataFrame:
    """Identifiers in section titles, once for each, of the dominant family and not among the keys."""
    titles = rows.select(F.col(section).alias("section")).distinct()
    found = with_identifier(titles, "section").filter(F.col("key").isNotNull())
    # the dominant family is one row
    return found.join(F.broadcast(family), "family").join(keys.select("key"), "key", "left_anti").groupBy("key").agg(F.min("section").alias("section"), F.min_by("display", "section").alias("display"))


def compare_sides(feature: DataFrame, system: DataFrame) -> DataFrame:
    """One row for each key of either side: status, display, rows and runs of rows, duplicates, and each side's first row.

    The sides come from side_keys; `feature_at` and `system_at` say where a key's first row stands."""
    f = feature.select("key", F.col("display").alias("f_display"), F.col("n_rows").alias("feature_rows"), F.col("blocks").alias("f_blocks"), F.col("first_at").alias("feature_at"))
    s = system.select("key", F.col("display").alias("s_display"), F.col("n_rows").alias("system_rows"), F.col("blocks").alias("s_blocks"), F.col("first_at").alias("system_at"))
    both = f.join(s, "key", "full_outer")
    status = F.when(F.col("f_blocks").isNull(), "missing_in_feature").when(F.col("s_blocks").isNull(), "missing_in_system").otherwise("covered")
    zero = F.lit(0).cast("long")
    f_blocks, s_blocks = F.coalesce("f_blocks", zero), F.coalesce("s_blocks", zero)
    return both.select(
        "key", status.alias("status"), F.coalesce("f_display", "s_display").alias("display"),
        F.coalesce("feature_rows", zero).alias("feature_rows"), F.coalesce("system_rows", zero).alias("system_rows"),
        f_blocks.alias("feature_count"), s_blocks.alias("system_count"), ((f_blocks > 1) | (s_blocks > 1)).alias("duplicate"), "feature_at", "system_at",
    )


def unresolved_entries(rows: DataFrame, side: str, id_column: str, order: str) -> DataFrame:
    """Rows whose identifier can't be read, one entry each."""
    return rows.filter(F.col("key").isNull()).select(F.lit(side).alias("side"), F.lit("unresolved").alias("status"), F.col(id_column).alias("display"), F.col(order).alias("row_index"))


def order_entries(entries: DataFrame) -> DataFrame:
    """entries with status_rank and natural_key, by which a writer can sort them."""
    rank = F.when(F.col("status") == "missing_in_system", 0).when(F.col("status") == "missing_in_feature", 1).when(F.col("status") == "covered", 2).otherwise(3)
    return entries.withColumn("status_rank", rank).withColumn("natural_key", T.natural_key("key"))


def coverage_summary(entries: DataFrame, unresolved: DataFrame | None = None, feature_family: DataFrame | None = None, system_family: DataFrame | None = None, related: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals and both percentages; a side without keys is covered in full. With the other tables also the number of
    unresolved rows, the family (the feature side's, else the system's) and the family of related ids.

    unresolved: entries of both sides; the families: one row from dominant_family; related: from supporting_family.
    by: one row for each of many comparisons, without those tables."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    pct = lambda part, whole: F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(100.0)
    a = entries.groupBy(*by).agg(
        n("covered", "missing_in_system").alias("feature_total"), n("covered", "missing_in_feature").alias("system_total"), n("covered").alias("covered"),
        n("missing_in_system").alias("missing_in_system"), n("missing_in_feature").alias("missing_in_feature"), F.count_if("duplicate").alias("duplicates"),
    )
    # each of these is one row
    if unresolved is not None:
        a = a.crossJoin(unresolved.agg(F.count("*").alias("unresolved")))
    if feature_family is not None and system_family is not None:
        one = lambda t, name: t.agg(F.max("family").alias(name))
        a = a.crossJoin(one(feature_family, "_f")).crossJoin(one(system_family, "_s")).withColumn("family", F.coalesce(F.nullif("_f", F.lit("")), "_s", F.lit(""))).drop("_f", "_s")
    if related is not None:
        a = a.crossJoin(related.agg(F.coalesce(F.max("token_family"), F.lit("")).alias("related_family")))
    return a.withColumns({"forward_pct": pct(F.col("covered"), F.col("feature_total")), "backward_pct": pct(F.col("covered"), F.col("system_total"))})


def mentioned(rows: DataFrame, texts: list[str], id_column: str, keep: list[str], row_order: str) -> DataFrame:
    """One row for each token of each row's texts: keep..., pos, token, canon, family, cell.

    The identifier column's first token is the key itself and left out. Cells without a digit are skipped
    before tokens are taken."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(c == id_column).alias("is_id"), F.col(c).alias("cell")) for i, c in enumerate(texts)])
    each = rows.filter(F.col("key").isNotNull()).select(*keep, row_order, F.explode(cells).alias("c")).filter(F.col("c.cell").rlike(r"\d"))
    each = each.select(*keep, row_order, "c.col_no", "c.is_id", "c.cell", F.posexplode(T.tokens("c.cell")).alias("token_no", "token"))
    each = each.filter(~(F.col("is_id") & (F.col("token_no") == 0)))
    return each.withColumn("canon", T.canonical("token")).withColumn("token_family", T.family_of("token"))


def related_ids(rows: DataFrame, texts: list[str], id_column: str, family: DataFrame, order: str, gather: int = GATHER_RELATED) -> DataFrame:
    """Supporting identifiers of each key: key, canon, token, family, cell, rank (first mention first).

    Not those of the primary family nor month names; of a key's rows, those after the row that reaches
    `gather` are not read, as the feature says."""
    each = mentioned(rows, texts, id_column, ["key"], order)
    month = F.lower(F.regexp_extract("token", "^[A-Za-z]+", 0)).isin(*T.MONTHS)
    each = each.filter(~month).join(F.broadcast(family.select(F.col("family").alias("_primary"))), F.col("token_family") != F.col("_primary")).drop("_primary")
    place = F.struct(order, "col_no", "token_no")
    first = each.groupBy("key", "canon").agg(F.min(place).alias("at"), F.min_by("token", place).alias("token"), F.min_by("token_family", place).alias("token_family"), F.min_by("cell", place).alias("cell"))
    w = Window.partitionBy("key").orderBy("at")
    before = F.count("*").over(Window.partitionBy("key").orderBy(F.col("at")[order]).rangeBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", before).filter(F.col("before") < gather).withColumn("rank", F.row_number().over(w)).select("key", "canon", "token", "token_family", "cell", "rank")


def supporting_family(related: DataFrame, most: int = MAX_RELATED) -> DataFrame:
    """related of the one family with most mentions (the smallest name on ties), at most `most` for each key."""
    counts = related.filter(F.col("token_family") != "").groupBy("token_family").agg(F.count("*").alias("n"))
    names = counts.groupBy().agg(F.min(F.struct(-F.col("n"), "token_family"))["token_family"].alias("token_family"))
    kept = related.join(F.broadcast(names), "token_family")
    place = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
    return kept.withColumn("place", place).filter(F.col("place") <= most).drop("rank")


def coverage_warnings(feature: DataFrame, system: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Warnings (by..., code, side) from summaries of the sides, as describe_sides gives them."""
    pack = lambda t, name: t.select(*by, F.struct(*[c for c in t.columns if c not in by]).alias(name))
    f, s = pack(feature, "f"), pack(system, "s")
    both = f.join(s, list(by)) if by else f.crossJoin(s)  # one row each
    mixed = F.when((F.col("f.family") != "") & (F.col("s.family") != "") & (F.col("f.family") != F.col("s.family")), F.struct(F.lit("family_mismatch").alias("code"), F.lit("").alias("side")))
    numeric = lambda x, name: F.when((F.col(f"{x}.numeric_ratio") >= NUMERIC_KEYS) & (F.col(f"{x}.occurrences") > 0), F.struct(F.lit("numeric_key_column").alias("code"), F.lit(name).alias("side")))
    return both.select(*by, F.inline(F.array_compact(F.array(mixed, numeric("f", "feature"), numeric("s", "system")))))


def describe_side(rows: DataFrame, by: str, order: str, sample: int = 20) -> DataFrame:
    """How each file's identifiers were read: first keys, different keys, matched, unresolved and all rows."""
    each = rows.withColumn("_first", F.when(F.col("key").isNotNull(), F.row_number().over(Window.partitionBy(by, "key").orderBy(order)) == 1))
    rank = F.row_number().over(Window.partitionBy(by, "_first").orderBy(order))
    each = each.withColumn("_rank", F.when(F.col("_first"), rank))
    return each.groupBy(by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= sample, F.struct("_rank", "display")))), lambda x: x["display"]), ",").alias("first_ids"),
        F.count_if("_first").alias("distinct_ids"), F.count("key").alias("matched"), F.count_if(F.col("key").isNull()).alias("unresolved"), F.count("*").alias("total"),
    )


def structural_problems(expected: DataFrame, sides: DataFrame) -> DataFrame:
    """layer_missing, no_data or no_ids for each expected layer; sides: layer, present, n_rows, ids."""
    problem = F.when(F.col("present").isNull(), "layer_missing").when(F.coalesce("n_rows", F.lit(0)) == 0, "no_data").when(F.coalesce("ids", F.lit(0)) == 0, "no_ids")
    return expected.join(sides, "layer", "left").select("layer", problem.alias("problem")).filter(F.col("problem").isNotNull())


def id_references(rows: DataFrame, texts: list[str], id_column: str, by: str, order: str) -> DataFrame:
    """Rows that name another identifier of their file's own family: by, key, canon, token, snippet, inside.

    Files are left out whose family is on fewer than half of the rows (no family doesn't count), or of
    which more than half of the rows' worth of findings would result."""
    n_rows = rows.groupBy(by).agg(F.count("*").alias("n_rows"))
    place = F.struct(F.col("n"), -F.col("at"))
    fam = rows.filter((F.col("key").isNotNull()) & (F.col("family") != "")).groupBy(by, "family").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    fam = fam.groupBy(by).agg(F.max_by("family", place).alias("own"), F.max("n").alias("carrying")).join(n_rows, by).filter(F.col("carrying") >= IDENTIFIER_SHARE * F.col("n_rows")).select(by, "own", "n_rows")
    # of the row's own family and another identifier: few are left to meet the files' families
    each = mentioned(rows, texts, id_column, [by, "key", "display", "family"], order).filter((F.col("token_family") == F.col("family")) & (F.col("canon") != F.col("key")))
    each = each.join(fam, by).filter(F.col("family") == F.col("own"))
    at = F.struct("col_no", "token_no")
    named = each.groupBy(by, order, "key", "display", "canon", "n_rows").agg(F.min_by("token", at).alias("token"), F.min_by("cell", at).alias("cell"))
    present = rows.filter(F.col("key").isNotNull()).select(by, F.col("key").alias("canon"), F.lit(True).alias("inside")).distinct()
    named = named.join(present, [by, "canon"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    found = named.groupBy(by).agg(F.count("*").alias("findings"))
    named = named.join(found, by).filter(F.col("findings") <= MISMATCH_SHARE * F.col("n_rows"))
    snippet = F.substring(F.trim(F.regexp_replace("cell", r"\s+", " ")), 1, SNIPPET)
    return named.select(by, order, "key", "display", "canon", "token", snippet.alias("snippet"), "inside")


def row_details(cells: DataFrame, at: list[str]) -> DataFrame:
    """at..., details: a row's filled cells as `key=value`, in the order of its columns; cells: at..., pos, key, s."""
    filled = cells.filter(F.trim("s") != "").groupBy(*at, "pos", "key").agg(F.min("s").alias("s"))  # rows that are there twice, once
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("=", "key", "s").alias("t"))))  # cells of one row
    return filled.groupBy(*at).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("details"))


def csv_rows(entries: DataFrame, related: DataFrame | None = None, feature_details: DataFrame | None = None, system_details: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """entries as the rows of a CSV export: id, status, duplicate flag, counts, and for each side the file, section and
    details of its first row; the related ids of a key beside the feature side.

    related: from supporting_family; details: the fields of first_at and `details`, as row_details gives them; keep:
    columns of entries that stay beside these (those of order_entries, say, for an ordered export)."""
    out = entries
    if related is not None:
        listed = related.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), "; ").alias("related"))  # at most MAX_RELATED
        out = out.join(listed, "key", "left")
    for side, details in (("feature", feature_details), ("system", system_details)):
        if details is not None:
            at = F.struct(*[F.col(f"{side}_at.{c}").alias(c) for c in details.columns if c != "details"])
            out = out.withColumn("_at", at).join(details.select(F.struct(*[c for c in details.columns if c != "details"]).alias("_at"), F.col("details").alias(f"{side}_details")), "_at", "left").drop("_at")
    names = entries.schema["feature_at"].dataType.fieldNames()
    place = lambda side, k: F.coalesce(F.col(f"{side}_at.{names[k]}").cast("string"), F.lit("")).alias(f"{side}_{('file', 'section')[k]}")
    more = [F.coalesce(c, F.lit("")).alias(c) for c in ("related", "feature_details", "system_details") if c in out.columns]
    return out.select(F.col("display").alias("id"), "status", F.when(F.col("duplicate"), "yes").otherwise("").alias("duplicate"), "feature_count", "system_count", *[place(s, k) for s in ("feature", "system") for k in (0, 1)], *more, *keep)
