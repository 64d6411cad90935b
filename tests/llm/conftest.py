import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns whose names clash with results."""
    def make(rows, extra=True):
        full = [(*r, *[None] * (3 - len(r))) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string")
        if extra:
            from pyspark.sql import functions as F
            for c in ("lang", "n_chars", "size", "kept", "length", "piece", "sequence_id", "score", "n_words", "component_id", "__n", "text_sha256"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make


NASTY = [
    (1, "a b c"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "a  b c"), (6, "a b c"), (6, "a b c"),
    (None, "no id"), (8, "é 日本 🙂 " * 50), (9, "word " * 3000), (10, "word " * 3000), (11, "x" * 5000), (12, "one"),
]


@pytest.fixture(scope="session")
def nasty():
    return list(NASTY)
