"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

LONG = "word " * 60_000 + "ende"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of them.", "en", "s1", 10),
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of them.", "en", "s1", 10),
    (2, None, None, None, None),
    (None, "A row without an id is kept as it is", "en", None, 5),
    (None, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \n\t\n ", "fr", "s1", 5),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "line one\nline two\nline three\nline four\n\nline five", "en", "s2", 50),
    (7, "other\nline one\nline two\nline three\nline four\n\nelse", "en", "s2", 50),
    (7, "the same id with another text", "en", "s2", 30),
    (8, "é ö 中文 😀 token = 'abcdef123' mail a.b@c.org at 10.0.0.1 or +1 (415) 555-0100", "de", "s3", 70),
]
# Columns named as the operators name theirs.
CLASHES = ["hash", "text_key", "item", "label", "rep", "band", "kept", "x", "rank", "bucket", "doc", "id", "row"]


def documents(spark, rows=ROWS, clashes=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clashes:
        for name in CLASHES:
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def empty(spark):
    return documents(spark).limit(0)
