"""Small documents with awkward rows."""

EXTRA = "key string, size int, bits string, before long, taken int, _rank int, tile string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def docs(spark, rows):
    """rows: (doc_id, text[, lang, source]); further columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "x", 1, "y", 2, 3, 4, "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "lorem ipsum dolor sit amet " * 4000
AWKWARD = [(1, None), (2, ""), (3, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, LONG), (None, "no id here at all"), (6, "Ünï çødé ▁ \t tabs\n\nlines 日本 😀"), (7, "   ")]
