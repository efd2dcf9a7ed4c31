"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (strong): assign, access, hex, leftmost and non-overlapping for each kind. A match's place
comes from the lengths of what the pattern splits off before it, so positions are code points of the
whole text.

Weak candidates are too common to report alone:
* key_part: a run of 40 characters of A-Z, a-z, 0-9, +, / (a bare secret), with a digit, an upper-case
  and a lower-case letter, outside an assign span;
* short_assign: an assignment of 6 to 11 characters;
* user: an account name given as user, username, login, account or client_id;
* endpoint: an http(s), ftp, jdbc-like or database address.
An interval join within scopes of one text (`scope` code points between starts) links them: a key_part
or short_assign needs an access identifier, user or endpoint in its scope; a user needs a secret; an
endpoint needs a secret and an identifier. Linked candidates are added to the spans; base spans stay.
The join is by cells of the scope's length: a candidate meets the parts of its own cell and of the two beside
it, and those within the scope remain. A scope is a distance, as texts have no other structure here, so a
candidate has no more partners than fit in two scopes, and a text of any length is joined by many tasks. Each
link names all its partners.

Defined results: a null text counts as empty and has no spans; rows that repeat doc_id and text have
equal results; ties of one start are ordered by kind; an empty table gives no rows; other columns
are not read. base_sha256 of a text without base spans is the digest of the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.llm import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is long enough: runs that are too short are dropped anyway and hide no other match.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY_PART = r"[A-Za-z0-9+/]{40,}"
USER = r"""(?i)(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+"""
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:@/?=&%+-]+"

ASSIGN_LEAST, SHORT_LEAST, KEY_LENGTH = 12, 6, 40
#: Code points between the starts of parts that belong together.
SCOPE = 400
#: All kinds, in the order of spans that start together.
KINDS = ("assign", "access", "hex", "key_part", "short_assign", "user", "endpoint")


def matches(kind: str, pattern: str, note) -> Column:
    """(kind_no, gaps, sizes, notes) of a pattern's matches in the column text; gaps: what stands before each."""
    text, found = F.col("text"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    length = lambda xs: F.transform(xs, lambda x: F.length(x))
    hit = F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), length(F.split(text, pattern, -1)).alias("gaps"), length(found).alias("sizes"), note(found).alias("notes"))
    return F.when(text.rlike(pattern), hit)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and the matches of every row, by kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = lambda found: F.transform(found, lambda x: F.lit(1))
    value_length = lambda found: F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v))
    whole_key = lambda found: F.transform(found, lambda v: ((F.length(v) == KEY_LENGTH) & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")).cast("int"))
    kinds = [("assign", ASSIGN, value_length), ("access", ACCESS, one), ("hex", HEX, one), ("key_part", KEY_PART, whole_key), ("user", USER, one), ("endpoint", ENDPOINT, one)]
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.array_compact(F.array(*[matches(*k) for k in kinds])).alias("found"))


def parts_of(rows: DataFrame) -> DataFrame:
    """doc_id, text_sha256, kind_no, start, end of all base spans and weak candidates, once for each text of a doc_id."""
    key = ["doc_id", "text_sha256"]
    each = rows.filter(F.size("found") > 0).dropDuplicates(key).select(*key, F.explode("found").alias("f"))
    steps = F.arrays_zip(F.slice(F.col("f.gaps"), F.lit(1), F.size("f.sizes")).alias("gap"), F.col("f.sizes").alias("size"), F.col("f.notes").alias("note"))
    each = each.select(*key, F.col("f.kind_no").alias("kind_no"), F.posexplode(steps).alias("k", "x")).select(*key, "kind_no", "k", "x.gap", "x.size", "x.note")
    so_far = Window.partitionBy(*key, "kind_no").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    assign, short, key_part = KINDS.index("assign"), KINDS.index("short_assign"), KINDS.index("key_part")
    least = F.when(F.col("kind_no") == assign, SHORT_LEAST).otherwise(1)
    each = each.filter(F.col("note") >= least).withColumn("kind_no", F.when((F.col("kind_no") == assign) & (F.col("note") < ASSIGN_LEAST), short).otherwise(F.col("kind_no")))
    # an assign span that begins before the end of a key_part and ends after its start
    reach = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, KEY_LENGTH - 1)
    each = each.withColumn("covered", F.coalesce(F.max(F.when(F.col("kind_no") == assign, F.col("end"))).over(reach), F.lit(0)) > F.col("start"))
    return each.filter((F.col("kind_no") != key_part) | ~F.col("covered")).select(*key, "kind_no", "start", "end")


#: What a weak candidate is linked by, by kind.
SECRETS, IDENTIFIERS, PLACES = ("assign", "hex", "key_part", "short_assign"), ("access", "user"), ("endpoint",)
NEEDED = {"key_part": (*IDENTIFIERS, *PLACES), "short_assign": (*IDENTIFIERS, *PLACES), "user": SECRETS, "endpoint": (*SECRETS, *IDENTIFIERS)}


def _numbers(names) -> list[int]:
    return [KINDS.index(x) for x in names]


def linked_pairs(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_sha256, kind_no, start, other_kind, other_start: each weak candidate with every complementary part in its scope."""
    cell = F.floor(F.col("start") / scope)
    weak = parts.filter(F.col("kind_no").isin(_numbers(NEEDED))).select("doc_id", "text_sha256", "kind_no", "start", F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
    other = parts.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("kind_no").alias("other_kind"), F.col("start").alias("other_start"), cell.alias("_own"))
    fits = F.lit(False)
    for kind, needs in NEEDED.items():
        fits = fits | ((F.col("kind_no") == KINDS.index(kind)) & F.col("other_kind").isin(_numbers(needs)))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")) & (F.col("_cell") == F.col("_own"))
    near = F.abs(F.col("start") - F.col("other_start")) <= scope
    return weak.join(other, same & near & fits).select("doc_id", "text_sha256", "kind_no", "start", "other_kind", "other_start")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The base spans, and those weak candidates that have complementary parts in their scope, with `partners`: all
    of these by start (null for base spans). An endpoint needs a secret and an identifier."""
    has = lambda names: F.bool_or(F.col("other_kind").isin(_numbers(names)))
    partners = F.array_sort(F.collect_list(F.struct(F.col("other_start").alias("start"), F.col("other_kind").alias("kind_no"))))  # within two scopes
    met = linked_pairs(parts, scope).groupBy("doc_id", "text_sha256", "kind_no", "start").agg(partners.alias("partners"), (has(SECRETS) & has(IDENTIFIERS)).alias("_both"))
    met = met.filter((F.col("kind_no") != KINDS.index("endpoint")) | F.col("_both"))
    names = {c: f"_{c}" for c in ("doc_id", "text_sha256", "kind_no", "start")}
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in ("text_sha256", "kind_no", "start"):
        same = same & (F.col(c) == F.col(names[c]))
    out = parts.join(met.withColumnsRenamed(names), same, "left").drop(*names.values(), "_both")
    return out.filter(F.col("kind_no").isin(_numbers(("assign", "access", "hex"))) | F.col("partners").isNotNull())


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, links for every row of docs; links: each linked weak
    candidate with all its partners, as kind:start>kind:start+kind:start."""
    rows = common.settle(scan(docs), "secret-scan")
    spans = link(parts_of(rows), scope)
    span = F.struct("start", "kind_no", "end", "partners")
    count = lambda kind: F.count_if(F.col("kind_no") == KINDS.index(kind))
    # a list holds the spans of one text
    listed = spans.groupBy("doc_id", "text_sha256").agg(
        F.array_sort(F.collect_list(span)).alias("all"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"))
    names = F.array(*[F.lit(k) for k in KINDS])
    kind = lambda x: F.element_at(names, x["kind_no"] + 1)
    place = lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    linked = F.filter("all", lambda x: x["partners"].isNotNull())
    links = F.array_join(F.transform(linked, lambda x: F.concat(place(x), F.lit(">"), F.array_join(F.transform(x["partners"], place), "+"))), ",")
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "n_assign", "n_access", "n_hex", text(F.filter("all", lambda x: x["kind_no"] <= 2)).alias("base"), text(F.col("all")).alias("spans"), links.alias("links"))
    out = rows.select("doc_id", "text_sha256").join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left")
    none, nothing = F.lit(0).cast("long"), F.lit("")
    return out.select("doc_id", *[F.coalesce(c, none).alias(c) for c in ("n_assign", "n_access", "n_hex")], F.sha2(F.coalesce("base", nothing), 256).alias("base_sha256"), F.coalesce("spans", nothing).alias("spans"), F.coalesce("links", nothing).alias("links"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.docs_of(spark, sf_dir))


def _sql_spans(no: int, pattern: str, flags: str, keep: str, group: int = 0) -> str:
    quoted = pattern.replace("(?i)", "").replace("'", "''")
    return f"""
  SELECT doc_id, {no} AS kind_no, start, start + length(m) AS "end", v AS value FROM (
    SELECT doc_id, unnest(found) AS m, unnest(vals) AS v, unnest(range(1, len(found) + 1)) AS k, gaps, found,
      CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start
    FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}', 0, '{flags}') AS found,
            regexp_extract_all(text, '{quoted}', {group}, '{flags}') AS vals,
            string_split_regex(text, '{quoted}', '{flags}') AS gaps FROM d)) WHERE {keep}"""


OP4_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nassigned AS ("
    + _sql_spans(0, ASSIGN, "i", "length(v) >= 6", 2)
    + "),\nparts AS (\n  SELECT doc_id, CASE WHEN length(value) >= 12 THEN 0 ELSE 4 END AS kind_no, start, \"end\" FROM assigned UNION ALL\n  SELECT doc_id, kind_no, start, \"end\" FROM (SELECT * FROM ("
    + ") UNION ALL SELECT * FROM (".join(_sql_spans(no, p, f, k) for no, p, f, k in (
        (1, ACCESS, "c", "true"), (2, HEX, "c", "true"),
        (3, KEY_PART, "c", "length(v) = 40 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"),
        (5, USER, "i", "true"), (6, ENDPOINT, "c", "true")))
    + """)) x
  WHERE kind_no <> 3 OR NOT EXISTS (SELECT 1 FROM assigned a WHERE a.doc_id = x.doc_id AND length(a.value) >= 12 AND a.start < x."end" AND x.start < a."end")),
named AS (SELECT *, (['assign', 'access', 'hex', 'key_part', 'short_assign', 'user', 'endpoint'])[kind_no + 1] || ':' || start AS name FROM parts),
told AS (
  SELECT p.doc_id, p.kind_no, p.start, p."end", p.name, string_agg(q.name, '+' ORDER BY q.start, q.kind_no) AS partners,
    count(*) FILTER (q.kind_no IN (0, 2, 3, 4)) > 0 AND count(*) FILTER (q.kind_no IN (1, 5)) > 0 AS whole
  FROM named p LEFT JOIN named q ON q.doc_id = p.doc_id AND abs(q.start - p.start) <= 400
    AND ((p.kind_no IN (3, 4) AND q.kind_no IN (1, 5, 6)) OR (p.kind_no = 5 AND q.kind_no IN (0, 2, 3, 4)) OR (p.kind_no = 6 AND q.kind_no < 6)) GROUP BY ALL),
kept AS (SELECT *, name || ':' || "end" AS span FROM told WHERE kind_no <= 2 OR (partners IS NOT NULL AND (kind_no < 6 OR whole)))
SELECT d.doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no <= 2), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no IS NOT NULL), '') AS spans, coalesce(string_agg(name || '>' || partners, ',' ORDER BY start, kind_no) FILTER (partners IS NOT NULL), '') AS links
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""
)
