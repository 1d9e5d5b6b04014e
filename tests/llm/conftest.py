import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Make a documents table of (doc_id, text) or longer rows, with columns whose names may clash."""

    def make(rows):
        full = [tuple(r) + (None, None, None)[: 5 - len(r)] for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("id", "th", "fp", "score", "node"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
