import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make(spark):
    """docs(texts or (id, text) pairs): a table with further columns whose names clash with results."""

    def docs(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for c in ("score", "key", "n_words", "own", "fp", "place", "name", "a", "items"):
            df = df.withColumn(c, F.lit("clash"))
        return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))

    return docs
