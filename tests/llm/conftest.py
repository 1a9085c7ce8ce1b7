import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet, " * 8000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns named like results."""
    rows = [
        (1, "One two three four five six seven.\nAnd a line.", "en", "s1"),
        (1, "One two three four five six seven.\nAnd a line.", "en", "s1"),
        (2, None, "en", "s1"),
        (3, "", None, None),
        (4, " \n\t ", "de", "s2"),
        (None, "A document without an id has words too, quite some of them.", "en", None),
        (5, LONG, "en", "s1"),
        (6, "x", None, "s2"),
        (7, "Ünï ćode 😀 tëxt 中文字 \x00\x01 end", "fr", "s3"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["n_chars", "ids", "decoded", "n_tokens", "score", "predicted", "x", "base", "random", "tested", "spans", "matches", "n_lines", "n_dropped", "line", "first", "items", "word_spans", "n_words", "kept", "distance", "sig", "node", "token", "component", "n", "grp", "y"]
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(names)])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
