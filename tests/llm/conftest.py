import pytest
from pyspark.sql import Row

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A builder of documents from texts; ids from 1."""

    def build(texts, sources=None, ids=None):
        rows = [
            Row(doc_id=(ids[k] if ids else k + 1), text=t, lang="en", source=(sources[k] if sources else "s"), n_chars=None if t is None else len(t)) for k, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOC) if rows else spark.createDataFrame([], DOC)

    return build
