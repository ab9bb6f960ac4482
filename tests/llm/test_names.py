"""Columns of every name an operator could use for itself stay as they were."""

import pytest
from pyspark.sql import functions as F

from resona.llm import decontaminate, language, passages, simhash, urls

NAMES = ["_key", "key", "_found", "found", "_cuts", "cuts", "_url", "hit", "_hit", "mark", "row", "first"]


@pytest.fixture
def clashing(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    rows = [(i, text * 5 if i % 2 else f"{text * 4} and number {i} of the kind", "en") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumns({n: F.lit(f"value of {n}") for n in NAMES})


def kept(frame, names=NAMES):
    rows = frame.collect()
    assert rows and all(r[n] == f"value of {n}" for r in rows for n in names)
    return rows


def test_stages(spark, clashing):
    benchmark = spark.createDataFrame([("b", "nothing of the kind " * 4)], "item_id string, text string")
    for stage in (
        language.with_known_language, lambda d: simhash.deduplicated(d, words_per_shingle=3, max_bits=2),
        passages.without_repeats, lambda d: decontaminate.without_contaminated(d, benchmark),
    ):
        found = stage(clashing)
        assert found.columns == clashing.columns
        kept(found)
    assert simhash.deduplicated(clashing, words_per_shingle=3, max_bits=2).count() < 6
    assert len(kept(language.identify(clashing))) == 6


def test_urls(spark):
    long = "https://www.example.org/" + "a/" * 200_000
    pages = spark.createDataFrame(
        [(1, "https://casino.example.com/x", "h"), (2, None, "h"), (3, long, "h")], "page_id long, url string, Host string")
    found = urls.judge(pages.withColumns({n: F.lit(f"value of {n}") for n in NAMES}))
    assert [c for c in found.columns if c in ("host", "path", "rule", "verdict")] == ["host", "path", "rule", "verdict"]
    rows = {r["page_id"]: r for r in kept(found)}
    assert rows[1]["host"] == "casino.example.com" and rows[2]["verdict"] == "allow" and rows[3]["host"] == "www.example.org"
