"""Awkward rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "alpha beta gamma delta " * 20_000

AWKWARD = [
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (None, "a text without an id", None, None, 20),
    (4, " \t\n ", "en", None, 4),
    (5, LONG, "en", "s", len(LONG)),
    (6, "one two", "en", "s", 7),
    (6, "one two", "en", "s", 7),
    (7, "\x00 odd ▁ signs � \U0001f600 ﬁ é é İ", "xx", "s", 1),
    (8, "!!!", "", "s", 3),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
