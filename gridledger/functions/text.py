"""Column functions over cell texts: normalising, shapes, identifiers, outcomes, figures.

All are built-in Spark expressions, so they stay in generated code. Null gives null unless stated."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values that results depend on.
ID_TOKEN = r"\b([A-Za-z][A-Za-z0-9]{0,7})[-_ ]?(\d+)\b"
MAX_ID_LENGTH = 40
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: ASCII characters that no number has.
NO_NUMBER = r"[!-*,/:-DF-df-~]"
#: Whole numbers that are their own canonical form.
PLAIN_WHOLE = r"^(?:0|[1-9][0-9]{0,14})\z"
#: White space of all scripts, with the separators that Unicode's property leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Whole numbers below this are written with all their digits.
WHOLE = 1e37
PASSING_WORDS = (
    "pass", "passed", "passing", "ok", "success", "successful", "complete", "completed", "done", "closed", "fixed", "verified", "approved", "green",
)
FAILING_WORDS = ("fail", "failed", "failing", "failure", "error", "blocked", "rejected", "broken", "ng", "red", "not ok")
PENDING_WORDS = (
    "not started", "yet to start", "in progress", "in-progress", "wip", "pending", "open", "todo", "to do", "deferred", "on hold", "not run",
    "skipped", "skip", "new", "n/a", "na", "not applicable", "in review",
)
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
)
TOTAL_TEST_FORMS = (
    "test count", "test counts", "test cases", "test case", "tests", "testcount", "testcases", "tc count", "tc cases", "tc counts",
    "total test count", "total test counts", "total test cases", "total test case", "total tests", "total cases", "total case",
    "no of test cases", "no of tests", "number of test cases", "number of tests",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """Decimal digits of other scripts, and the ASCII digit of each."""
    found = [chr(i) for i in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def ascii_digits(c: Column | str) -> Column:
    """A text with the digits of other scripts (full-width ones, say) as ASCII digits."""
    text = _col(c)
    return F.when(text.rlike(r"[\p{Nd}&&[^\x00-\x7F]]"), F.translate(text, *_digits())).otherwise(text)


def _spaced(c: Column | str) -> Column:
    text = _col(c)  # most texts have nothing to replace
    return F.when(text.rlike(r"^ | $|  |[^\x20-\x7E]"), F.trim(F.regexp_replace(text, SPACE + "+", " "))).otherwise(text)


def clean(c: Column | str) -> Column:
    """Runs of white space of any script to one space, trimmed; empty gives null."""
    return F.nullif(_spaced(c), F.lit(""))


def number_of(c: Column | str) -> Column:
    """The finite number that a text is, in the digits of any script, else null. nan, inf, 1_000 and 1d stay text."""
    n = _number(ascii_digits(c))
    return F.when(F.abs(n) != float("inf"), n)


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def _written_whole(n: Column) -> Column:
    """All digits of a whole double below WHOLE: what is over 2^62 and what is left, each exact as a long."""
    unit = F.lit(float(1 << 62))
    high = F.floor(n / unit)
    big = high.cast("decimal(18,0)") * F.lit(1 << 62).cast("decimal(19,0)") + (n - high * unit).cast("long").cast("decimal(19,0)")
    return F.when(F.abs(n) < float(1 << 62), n.cast("long").cast("string")).otherwise(big.cast("string"))


def norm_cell(c: Column | str) -> Column:
    """struct(s, n): canonical text, and the number if the cell is one. Integral numbers lose their point.

    Steps are bound by lambdas over one element, so that each is evaluated once."""

    def written(cell: Column) -> Column:
        text, n = cell["t"], F.when(F.abs(cell["n"]) != float("inf"), cell["n"])
        whole = (F.abs(n) < WHOLE) & (n == F.rint(n))
        s = F.when(n.isNull(), text).when(whole, _written_whole(n)).otherwise(n.cast("string"))
        return F.when(text.isNotNull(), F.struct(s.alias("s"), n.alias("n")))

    cells = F.transform(F.array(_spaced(c)), lambda t: F.nullif(t, F.lit("")))
    digits = F.transform(cells, lambda t: F.struct(t.alias("t"), ascii_digits(t).alias("d")))
    numbered = F.transform(digits, lambda x: F.struct(x["t"].alias("t"), _number(x["d"]).alias("n")))
    # most cells are as they are written: plain texts, and whole numbers that a double holds exactly
    text, none = _col(c), F.lit(None).cast("double")
    spaced = text.rlike(r"[^\x20-\x7E]") | text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    plain = F.when(text.rlike(NO_NUMBER) & ~spaced, F.struct(text.alias("s"), none.alias("n"))).when(text.rlike(PLAIN_WHOLE), F.struct(text.alias("s"), text.try_cast("double").alias("n")))
    return F.when(text.isNotNull(), F.coalesce(plain, F.get(F.transform(numbered, written), 0)))


def cell_shape(s: Column | str, n: Column | str) -> Column:
    """'#' for a number; else letter runs as A and digit runs as 9; '' for an empty cell."""
    cell = _col(s)
    other = F.regexp_replace(F.regexp_replace(cell, r"(?U)[^\W\d_]+", "A"), r"(?U)\d+", "9")
    text = F.when(cell.rlike(r"[^\x00-\x7F]"), other).otherwise(F.regexp_replace(F.regexp_replace(cell, "[A-Za-z]+", "A"), "[0-9]+", "9"))
    return F.when(_col(n).isNotNull(), F.lit("#")).otherwise(F.coalesce(text, F.lit("")))


def column_key(label: Column | str) -> Column:
    """Lower case, other characters as single underscores, none at the ends; 'column' if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(_col(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("column"))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain_slug(c: Column | str) -> Column:
    """A slug without a trailing -test, -tests or -testing."""
    return F.regexp_replace(slug(c), "-(test|tests|testing)$", "")


def measure_identity(label: Column | str, key: Column | str) -> Column:
    """'total_tests' for the known forms of a test count, else the column's own key."""
    words = F.array_join(F.regexp_extract_all(F.lower(_col(label)), F.lit("([a-z]+)"), F.lit(1)), " ")
    return F.when(words.isin(*TOTAL_TEST_FORMS), F.lit("total_tests")).otherwise(_col(key))


def outcome_of(c: Column | str) -> Column:
    """passing, failing, pending, or '' for an unknown or empty status word."""
    word = F.lower(F.regexp_replace(_spaced(F.coalesce(_col(c), F.lit(""))), r"^[.!:]+|[.!:]+$", ""))
    return F.when(word.isin(*PASSING_WORDS), "passing").when(word.isin(*FAILING_WORDS), "failing").when(word.isin(*PENDING_WORDS), "pending").otherwise("")


def checked_pattern(pattern: str | None) -> str | None:
    """An override pattern as the JVM reads it, or None if it doesn't compile there (checked on the driver).

    Named groups may be written (?P<name>...) and (?P=name), as users of other engines write them."""
    if not pattern:
        return None
    own = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    own = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", own)
    spark = SparkSession.getActiveSession() or SparkSession.getDefaultSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?U)" + own)
    except Exception:  # a syntax error of either engine; the JVM's comes wrapped
        return None
    return own


def tokens(c: Column | str, pattern: str | None = None) -> Column:
    """Identifier-shaped runs of a text, in order."""
    own = checked_pattern(pattern)
    # letters, digits and word ends of all scripts count
    read = lambda t, flag: F.regexp_extract_all(t, F.lit(flag + (own or ID_TOKEN)), F.lit(0))
    found = _by_script(_col(c), read) if own is None else read(_col(c), "(?U)")
    # the built-in pattern gives no spaces around a token and no empty one
    return found if own is None else F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def _by_script(text: Column, read) -> Column:
    """read(text, flag): the flag for classes of all scripts, which cost many times as much, only where a text needs it."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), read(text, "(?U)")).otherwise(read(text, ""))


def first_token(c: Column | str) -> Column:
    """The first token by the built-in pattern, else null; a plain expression, without an array."""
    return F.nullif(_by_script(_col(c), lambda t, flag: F.regexp_extract(t, flag + ID_TOKEN, 0)), F.lit(""))


def canonical(c: Column | str) -> Column:
    """Match key: without white space, hyphens and underscores, in lower case."""
    text = _col(c)
    plain = F.translate(text, "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f -_", "")
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\-_]+", "")).otherwise(plain))


def family_of(c: Column | str) -> Column:
    """Leading letters in upper case, '' if there are none."""
    return F.upper(F.regexp_extract(_col(c), "^[A-Za-z]+", 0))


def read_identifier(c: Column | str, pattern: str | None = None) -> Column:
    """struct(key, display, family) of a cell: its first token; without an override, also a short cell with a digit."""
    own = checked_pattern(pattern)

    def shown(text: Column) -> Column:
        first = F.get(tokens(text, own), 0)
        whole = F.when((F.length(text) <= MAX_ID_LENGTH) & text.rlike(r"(?U)\d"), text) if own is None else F.lit(None).cast("string")
        return F.coalesce(first, whole)

    # bound by lambdas over one element, so that each step is evaluated once
    displays = F.transform(F.transform(F.array(clean(c)), shown), lambda d: F.when(d.isNotNull(), F.struct(canonical(d).alias("key"), d.alias("display"), family_of(d).alias("family"))))
    return F.get(displays, 0)


def is_identifier(c: Column | str) -> Column:
    """Whether read_identifier finds one by the built-in pattern; a plain expression."""
    text = clean(c)
    return first_token(text).isNotNull() | F.coalesce((F.length(text) <= MAX_ID_LENGTH) & text.rlike(r"(?U)\d"), F.lit(False))


def natural_key(c: Column | str) -> Column:
    """Sorts FL-9 before FL-10: text and digit runs in turn, beginning with text. A run of any length goes by its
    number: how many digits it has without leading zeros, then these."""
    key = ascii_digits(c)
    parts = F.regexp_extract_all(key, F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    sized = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p))
    return F.when(key.rlike(r"^\d"), F.concat(F.array(F.lit("")), sized)).otherwise(sized)


def figures(c: Column | str) -> Column:
    """The different numbers of a text, written one way: 140,789 and 140789.0 agree."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?<=\d),(?=\d{3}(?!\d))", "")
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, r"^0+(?=\d)", ""), r"\.0+$", "")
    return F.array_distinct(F.transform(found, lambda x: F.when(whole(x).contains("."), F.regexp_replace(whole(x), "0+$", "")).otherwise(whole(x))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
