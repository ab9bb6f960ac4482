import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.operators import clustering as K
from resona.operators import relevance as R
from resona.operators.dictionary import forms_by_token, replace_tokens


@pytest.fixture(scope="module")
def lemmas(spark):
    """100,000 entries, half of them for verbs."""
    ids = spark.range(100_000)
    return ids.select(
        F.concat(F.lit("w"), (F.col("id") / 2).cast("long")).alias("token"), F.when(F.col("id") % 2 == 0, "n").otherwise("v").alias("pos"),
        F.concat(F.lit("l"), (F.col("id") / 2).cast("long"), F.when(F.col("id") % 2 == 0, "").otherwise(" to")).alias("form"))


def collected(frame, column="tokens"):
    return {r["id"]: r[column] for r in frame.collect()}


def test_large_tables_keep_the_order(spark, lemmas):
    random.seed(2)
    rows = [(i, [random.choice(["the", f"W{random.randrange(60_000)}", "w7"]) for _ in range(random.randrange(60))], "x") for i in range(300)]
    rows += [(1000, [], "x"), (1001, None, "x"), (1002, ["The", "the"], "x"), (1003, ["w7"] * 500, "x")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, form string")

    def brute(tokens, verbs):
        out = []
        for t in tokens or []:
            t = t.lower()
            n = int(t[1:]) if t[1:].isdigit() else 10 ** 9
            out += [t] if n >= 50_000 else [f"l{n}", "to"] if t in verbs else [f"l{n}"]
        return out if tokens is not None else None

    for verbs in (set(), {"w7", "w8"}):
        tags = spark.createDataFrame([(v, "v") for v in verbs], "token string, pos string")
        found = replace_tokens(df, "id", lemmas, tags=tags, rows_per_task=50)
        assert found.columns == df.columns and found.where("form <> 'x'").isEmpty()
        assert collected(found) == {i: brute(t, verbs) for i, t, _ in rows}
    assert forms_by_token(lemmas).count() == 50_000


def test_parts_of_speech_beside_the_tokens(spark, lemmas):
    df = spark.createDataFrame([(1, ["w1", "w1", "w2", "zz"], ["v", "n", None, "v"])], "id long, tokens array<string>, pos array<string>")
    assert collected(replace_tokens(df, "id", lemmas, pos="pos")) == {1: ["l1", "to", "l1", "l2", "zz"]}


def test_cluster_tokens_with_a_table(spark):
    df = spark.createDataFrame([("a", "lovely serums and lipsticks"), ("b", None)], "commentid string, commenttext string")
    forms = spark.createDataFrame([("serums", "serum"), ("lipsticks", "lip stick")], "token string, form string")
    rows = {r["commentid"]: (r["tokens"], r["textcleaned"]) for r in K.cluster_preprocess(df, lemmas=forms).collect()}
    assert rows["a"] == (["lovely", "serum", "lip", "stick"], "lovely serum lip stick") and rows["b"] == ([], "")


def test_relevance_by_given_vectors(spark):
    vectors = {"a": [3.0, 4.0], "b": [0.0, 0.0], "c": None, "d": [-1.0, 0.5], "e": [1.0, 1.0]}
    rows = [(k, v, f"text {k}", "v1" if k != "e" else "v2") for k, v in vectors.items()]
    comments = spark.createDataFrame(rows, "commentid string, embedding array<float>, commenttext string, videoid string")
    videos = spark.createDataFrame(
        [("v1", [1.0, 2.0], "title", None, ["x"]), ("v2", None, "title", None, ["x"])],
        "videoid string, embedding array<float>, title string, description string, tags array<string>")
    unit = np.array([1.0, 2.0]) / np.sqrt(5)
    expected = {k: float(np.dot(v, unit) / np.linalg.norm(v)) if v and any(v) and k != "e" else None for k, v in vectors.items()}
    got = {r["commentid"]: r["cosine"] for r in R.cosine_of_vectors(comments, videos).collect()}
    assert {k: v if v is None else pytest.approx(v) for k, v in expected.items()} == got
    scored = R.relevance(R.preprocess_comments(comments), videos, vector="embedding").collect()
    assert {r["commentid"]: r["weighted_relevance"] for r in scored} == {k: pytest.approx(v or 0.0) for k, v in expected.items()}


def test_only_words_with_a_form_come_back_to_their_row(spark):
    forms = spark.createDataFrame([("cats", "cat"), ("nyc", "new york"), ("gone", None)], "token string, form string")
    rows = [(1, ["Cats", "x", "cats", None, "nyc"]), (2, ["gone", "A b"]), (2, ["cats"]), (None, ["Cats"]), (3, [None]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    found = sorted((str(r.id), r.tokens) for r in replace_tokens(df, "id", forms).collect() if r.tokens)
    assert found == [
        ("1", ["cat", "x", "cat", "new", "york"]), ("2", ["cat"]), ("2", ["gone", "a", "b"]), ("3", [None]), ("None", ["Cats"])]
    met = replace_tokens(df, "id", forms)._jdf.queryExecution().optimizedPlan().toString()
    assert "places" not in met and "collect_list" not in met
