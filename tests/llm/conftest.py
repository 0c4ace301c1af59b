import pytest

LONG = "x" * 300_000
DIGITS = "12" * 60_000
MANY = "word " * 60_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, ties, and
    columns whose names the operators use themselves."""
    rows = [
        (1, "Some plain text. With two lines\nand a 42 here", "en", "s", 5),
        (1, "Some plain text. With two lines\nand a 42 here", "en", "s", 5),
        (2, "  Some plain text.\tWith two lines\nand a 42 here", "en", None, 5),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, " \t\n", "en", "s", 3),
        (None, "Some plain text. With two lines\nand a 42 here", "en", "s", 5),
        (None, None, None, None, None),
        (6, LONG, "en", "s", len(LONG)),
        (7, DIGITS, "en", "s", len(DIGITS)),
        (8, MANY, "en", "s", len(MANY)),
        (9, "Mail a.b@example.com or +1 (555) 010-2000 <|endoftext|> don't", "en", "s", 1),
        (10, "é\u0301 ﬁ 日本語 😀 \x1c\u2003x", "xx", "s", 1),
        (-5, "one two three four five six seven eight", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = ["norm", "sha", "row", "rank", "length", "piece", "fp", "rep", "component", "held", "score", "leaf", "h1", "__gone", "salt", "order", "key", "block", "ids", "toxic", "n_dropped_x"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
