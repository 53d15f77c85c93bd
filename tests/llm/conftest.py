import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a documents table with a column that clashes with nothing, and one that might."""

    def make(rows, source="s", extra=True):
        full = [(i, t, "en", source if isinstance(source, str) else source(i), len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS score", "'x' AS shard", "2 AS rank") if extra else df

    return make


#: Null, empty, blank, very long, repeated and tied texts.
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word " * 60000), (5, "tie one two three four five"), (5, "tie one two three four five"), (6, "tie one two three four five"), (None, "no id at all here today"), (7, "é" * 3000)]
