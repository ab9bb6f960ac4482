"""Every query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import cells, connect


@pytest.fixture(scope="module")
def duck(base):
    return connect(base)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, base, duck, name):
    df = entry.queries()[name](spark, base)
    got = df.collect()
    relation = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    assert sorted(df.columns) == sorted(columns)
    assert got, "a query without rows checks nothing"
    assert cells(got, df.columns) == cells(relation.fetchall(), columns)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, duck):
    """Mean score by category of the whole chain, categories fitted on the comments."""
    rows = {r["cluster_label"]: r["avg_prs"] for r in entry.entry(spark).collect()}
    chain = entry.oracle_sql()["score_comments"]
    expected = dict(duck.execute(
        f"SELECT cluster_label, avg(product_resonance_score) FROM ({chain}) GROUP BY cluster_label").fetchall())
    assert rows == {k: pytest.approx(v, abs=1e-5) for k, v in expected.items()} and len(rows) > 1
