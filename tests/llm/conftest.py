import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names could clash."""

    def make(*rows):
        full = [(i, t, rest[0] if rest else "en", "s", len(t or "")) for i, t, *rest in rows]
        frame = spark.createDataFrame(full, DOCS)
        clash = ["key", "score", "ids", "part", "own", "row", "first", "fp", "label", "mark", "sig", "host"]
        return frame.withColumns({c: F.lit("x") for c in clash})

    return make
