"""Documents with everything an operator may meet."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
PLAIN = "One two three four five six seven eight nine ten eleven twelve."

# Extra columns bear names that operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, text_a string, kept boolean, label int, spans string"

ROWS = [
    (1, PLAIN, "en", "a", 63, 1, "x", True, 1, "s"),
    (1, PLAIN, "en", "a", 63, 1, "x", True, 1, "s"),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 1, "x", True, 1, "s"),
    (4, " \n\t ", "en", "a", 4, 1, "x", True, 1, "s"),
    (None, PLAIN, "en", "a", 63, 1, "x", True, 1, "s"),
    (None, None, "en", "a", 63, 1, "x", True, 1, "s"),
    (5, LONG, "en", "a", len(LONG), 1, "x", True, 1, "s"),
    (6, "ünïcödé wörds ☃ 漢字 " * 3, "de", "b", 51, 1, "x", False, 0, ""),
    (-7, "token = \"abcdef0123456789abcdef\"", "en", "b", 32, 1, "x", False, 0, ""),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)
