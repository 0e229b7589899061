"""A session that the text operators' tests share, and small tables."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def labelled(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)
