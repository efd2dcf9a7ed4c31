from pyspark.sql import functions as F

from gridledger.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first().v


def test_norm_cell(spark):
    df = spark.createDataFrame([(" a  b ",), ("12",), ("12.0",), ("2.5",), ("  ",), (None,), ("1d",), ("nan",), ("1_000",)], "c string")
    got = [(r.v.s, r.v.n) if r.v else None for r in df.select(T.norm_cell("c").alias("v")).collect()]
    assert got == [("a b", None), ("12", 12.0), ("12", 12.0), ("2.5", 2.5), None, None, ("1d", None), ("nan", None), ("1_000", None)]


def test_cells_of_other_scripts(spark):
    """White space and digits of all scripts; whole numbers keep all digits of their double."""
    cases = {"TC\u20031": ("TC 1", None), "\u3000\u2003\u202f": None, "\uff11\uff12": ("12", 12.0), "\u0661.5": ("1.5", 1.5), "a\u001cb": ("a b", None),
             "1234567890123456789": ("1234567890123456768", 1234567890123456768.0), "-98765432109876543210987": (str(int(-98765432109876543210987.0)), -98765432109876543210987.0),
             "1e30": ("1000000000000000019884624838656", 1e30), "-7": ("-7", -7.0), "1e400": ("1e400", None), "4611686018427387904": ("4611686018427387904", 2.0**62)}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: (r.v.s, r.v.n) if r.v else None for r in df.select("c", T.norm_cell("c").alias("v")).collect()}
    assert got == cases
    assert all(str(int(v[1])) == v[0] for v in cases.values() if v and v[1] is not None and v[1] % 1 == 0)
    keys = spark.createDataFrame([("TC 1",), ("TC\u30001",), ("tc\u202f\u20091",), ("TC_1",)], "c string")
    assert {r.v.key for r in keys.select(T.read_identifier("c").alias("v")).collect()} == {"tc1"}
    assert [r.v for r in keys.limit(1).select(T.outcome_of(F.lit("not\u2003ok!")).alias("v")).collect()] == ["failing"]


def test_shapes(spark):
    df = spark.createDataFrame([("QX-210", None), ("3-Mar-24", None), ("Crane task name", None), ("5", 5.0), (None, None), ("Größe 12", None)], "s string, n double")
    assert [r.v for r in df.select(T.cell_shape("s", "n").alias("v")).collect()] == ["A-9", "9-A-9", "A A A", "#", "", "A 9"]


def test_keys_and_slugs(spark):
    df = spark.createDataFrame([("Test Count!",), ("***",), ("Regression tests",)], "c string")
    assert [tuple(r) for r in df.select(T.column_key("c"), T.slug("c"), T.plain_slug("c")).collect()] == [("test_count", "test-count", "test-count"), ("column", "", ""), ("regression_tests", "regression-tests", "regression")]


def test_measure_identity(spark):
    df = spark.createDataFrame([("Test Count",), ("No. of Test Cases",), ("Automated Test Count",), ("TC count",)], "c string")
    assert [r.v for r in df.select(T.measure_identity("c", F.lit("own")).alias("v")).collect()] == ["total_tests", "total_tests", "own", "total_tests"]


def test_outcomes(spark):
    df = spark.createDataFrame([("Passed.",), (" NOT  ok ",), ("N/A",), ("maybe",), ("",), (None,)], "c string")
    assert [r.v for r in df.select(T.outcome_of("c").alias("v")).collect()] == ["passing", "failing", "pending", "", "", ""]


def test_identifiers(spark):
    df = spark.createDataFrame([("QX-210: rope for K7",), ("qx 210",), ("210",), ("1.2.3",), ("plain prose",), ("x" * 50 + "1",), (None,)], "c string")
    got = [tuple(r.v) if r.v else None for r in df.select(T.read_identifier("c").alias("v")).collect()]
    assert got[:4] == [("qx210", "QX-210", "QX"), ("qx210", "qx 210", "QX"), ("210", "210", ""), ("1.2.3", "1.2.3", "")]
    assert got[4:] == [None, None, None]


def test_tokens_beside_other_scripts(spark):
    df = spark.createDataFrame([("“QX-12” and QX-13\u00a0then QX-14—",), ("日QX-12 QX-13日 QX日14 éQX-1",), ("QX-1é AB 2",)], "c string")
    assert [r.v for r in df.select(T.tokens("c").alias("v")).collect()] == [["QX-12", "QX-13", "QX-14"], [], ["AB 2"]]


def test_override_pattern(spark):
    df = spark.createDataFrame([("req#77 FL-1",), ("FL-1",)], "c string")
    got = [tuple(r.v) if r.v else None for r in df.select(T.read_identifier("c", r"req#\d+").alias("v")).collect()]
    assert got == [("req#77", "req#77", "REQ"), None]
    # what doesn't compile, for whichever engine, falls back to the built-in token
    assert T.checked_pattern("(") is None and T.checked_pattern("[a-") is None and T.checked_pattern("(?P<n>x") is None and T.checked_pattern("a(?(1)b|c)") is None
    named = r"(?P<fam_ily>FL)-(?P<n>\d+)(?P=fam_ily)?"
    assert [r.v.display for r in df.select(T.read_identifier("c", named).alias("v")).collect()] == ["FL-1", "FL-1"]
    assert [r.v.display for r in df.select(T.read_identifier("c", "a(?(1)b|c)").alias("v")).collect()] == ["FL-1", "FL-1"]


def test_natural_order(spark):
    df = spark.createDataFrame([("FL-10",), ("FL-2",), ("FL-1",), ("7",)], "c string").orderBy(T.natural_key("c"))
    assert [r.c for r in df.collect()] == ["7", "FL-1", "FL-2", "FL-10"]
    long = ["FL-1234567890123456789012", "FL-1234567890123456789013", "FL-9234567890123456789012", "FL-10234567890123456789012", "FL-\uff11\uff10\uff12\uff13\uff14567890123456789013"]
    df = spark.createDataFrame([(x,) for x in long[::-1]], "c string")
    assert [r.c for r in df.orderBy(T.natural_key("c")).collect()] == long  # no run is cut, so none tie
    assert df.select(T.natural_key(F.lit("FL-007")).alias("a"), T.natural_key(F.lit("FL-7")).alias("b")).filter("a = b").count() == 5


def test_figures(spark):
    df = spark.createDataFrame([("231,604 boxes, 12.5% of QX-77; part 3.2.8 and 231604.0, 1,2,345",), (None,)], "c string")
    got = [set(r.v) for r in df.select(T.figures("c").alias("v")).collect()]
    assert got == [{"231604", "12.5", "77", "3.2", "8", "1", "2345"}, set()]


def test_is_identifier(spark):
    df = spark.createDataFrame([(x,) for x in ("QX-210: rope", "210", "1.2.3", "plain prose", "x" * 50 + "1", "", None, "١", "v2")], "c string")
    got = df.select((T.read_identifier("c").isNotNull() == T.is_identifier("c")).alias("v")).collect()
    assert all(r.v for r in got)


def test_plain_texts_are_read_by_plain_classes(spark):
    """Texts of ASCII and of other scripts give the same tokens and keys as the classes of all scripts."""
    ascii_ = ["".join(map(chr, range(128))), "FL-12 and a_3", "xFL-1", "FL 1é", "éFL-1", "FL-1\x1c2", "A1 2\t\x0b3", "", None, "ab\x1f-_ 9"]
    found = spark.createDataFrame([(t,) for t in ascii_], "t string")
    every = F.regexp_extract_all("t", F.lit("(?U)" + T.ID_TOKEN), F.lit(0))
    key = F.lower(F.regexp_replace("t", r"(?U)[\s\x1c-\x1f\-_]+", ""))
    first = F.nullif(F.regexp_extract("t", "(?U)" + T.ID_TOKEN, 0), F.lit(""))
    assert found.filter(~(T.tokens("t").eqNullSafe(every) & T.canonical("t").eqNullSafe(key) & T.first_token("t").eqNullSafe(first))).count() == 0
    plan = lambda c: found.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("CASE WHEN RLIKE(t" in plan(c) for c in (T.tokens("t"), T.canonical("t"), T.first_token("t")))
