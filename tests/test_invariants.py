"""Queries without a SQL twin: what must hold of their results."""

import pytest

import __spark_entry__ as entry
from resona.plans.registry import registry


@pytest.fixture(scope="module")
def run(spark, base):
    return lambda name: entry.queries()[name](spark, base).collect()


def test_trained_models_score_every_document(run):
    spam, mood = run("spam_model_trained"), run("sentiment_trained")
    assert len(spam) == len(mood) == 200
    assert all(0 <= r["spam_score"] <= 1 for r in spam)
    assert all(r["is_spam"] == (r["spam_score"] >= 0.3) for r in spam)
    assert all(0.5 <= r["sentiment_score"] <= 1 for r in mood)


def test_word_vectors(run):
    rows = run("text_embedding_word2vec")
    assert len(rows) == 200 and {r["dimensions"] for r in rows} == {32}


def test_kmeans(run):
    rows = run("kmeans")
    assert {r["cluster"] for r in rows} == {0, 1, 2}
    assert sum(r["weight"] for r in rows) == len(run("valid_row_mask"))


def test_choose_k(run):
    rows = run("choose_k")
    assert [r["k"] for r in rows] == [2, 3, 4, 5, 6]
    assert [r["score"] for r in rows if r["chosen"]] == [max(r["score"] for r in rows)]


def test_keyphrases(run):
    rows = run("cluster_keyphrases_mmr")
    picked = [(r["cluster_label"], r["phrase"]) for r in rows]
    assert len(set(picked)) == len(picked) == 60


def test_product_clusters(run):
    rows = run("product_clusters")
    assert len(rows) == 1000 and len({r["commentid"] for r in rows}) == 1000
    assert len({r["cluster_label"] for r in rows}) > 1


def test_registry_is_complete():
    names = set(registry())
    assert len(names) == 118 and names <= set(entry.queries())
    without_sql = names - set(entry.oracle_sql())
    assert without_sql == {
        "spam_model_trained", "sentiment_trained", "text_embedding_word2vec", "cluster_keyphrases_mmr",
    }
