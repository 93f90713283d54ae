import pytest

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns whose names the operators use inside."""
    rows = [
        (1, "A plain text of more than ten words, said once and then no more.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "en", "b"),
        (5, LONG, "en", "a"),
        (6, "A plain text of more than ten words, said once and then no more.", "en", "b"),
        (6, "A plain text of more than ten words, said once and then no more.", "en", "b"),
        (None, "A plain text of more than ten words, said once and then no more.", "en", None),
        (None, None, None, None),
        (7, "日本語 テキスト é ́ <|endoftext|> 4111 1111 1111 1111", "ja", "c"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return d.withColumns({"n_chars": F.length("text").cast("long"), "_t": F.lit("x"), "_doc": F.lit(1), "rep": F.lit(2), "piece": F.lit(3), "copies": F.lit(9), "size": F.lit(4), "text_": F.lit("y")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
