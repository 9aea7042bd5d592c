import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``{doc_id: text}`` or ``(doc_id, text)`` pairs, with extra columns whose names clash with results."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
        T.StructField("spans", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("component_id", T.StringType())])

    def make(texts, langs=None):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [(i, t, (langs or {}).get(i), "s", len(t) if t is not None else None, "x", "x", "x", "x") for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


EDGE = {0: None, 1: "", 2: "   \n\t ", 3: "one", 4: "one", 5: "éà中文 \U0001F600", 6: "!!! ??? ...", 7: "a " * 30_000, 8: "x" * 70_000}


@pytest.fixture(scope="session")
def edge_texts():
    return dict(EDGE)
