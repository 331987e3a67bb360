import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, lang, source]) as a table of documents."""
    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
