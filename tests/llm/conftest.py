import pytest


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text), with columns whose names could clash."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' AS n_words", "'y' AS row", "1 AS kept", "'z' AS node", "'l' AS length", "0 AS score")

    return make
