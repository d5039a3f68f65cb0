import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture
def clash():
    """Adds columns whose names operators use inside."""
    names = ("score", "size", "words_", "node", "k1", "k2", "rid", "anchor", "document", "kept", "text_", "found", "n", "x", "w", "unit", "v", "norm")

    def add(df):
        return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})

    return add


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
