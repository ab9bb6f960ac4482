import re

import pytest
from pyspark.sql import functions as F

from resona.functions import rules as R
from resona.functions.guard import check_sql
from resona.operators import actionability as A
from resona.operators import prs, relevance, sentiment, spam
from resona.sources import derived as D


def expected_rule(text):
    """The ladder in plain Python."""
    if not text or not text.strip():
        return "a"
    t = text.lower().strip()
    w = t.split()
    checks = [
        ("b", len(t) > 500),
        ("c", any(x in t for x in ("http", "www", ".com", ".net", ".org", ".info", ".xyz"))),
        ("d", max(w.count(x) for x in w) > 10),
        ("e", len(t) > 20 and sum(c.isupper() for c in t) / len(t) > 0.8),
        ("f", len(t) > 10 and len(set(t)) < 4),
        ("g", len(w) < 2 and len(t) < 5),
        ("h", sum(not c.isalnum() for c in t) / len(t) > 0.8),
        ("i", len(w) > 10 and len(set(w)) < 3),
        ("j", t.count("@") > 5),
    ]
    return next((name for name, hit in checks if hit), None)


TEXTS = D.PHRASES + [
    None, "    ", "x" * 500, "ab " * 250, "awww", "go " * 10, "go " * 11, "🅰" * 21, "aab" * 4,
    "abcd", "a!!!!", "a!!!!!", "no yes " * 6, "@" * 5 + " mail me", "²²²²²", "á!!!!!!!!!!!!",
    "Ünïcödé tëxt",
]


def test_spam_rules_follow_the_ladder(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, commenttext string")
    got = {r["id"]: r["first_rule"] for r in spam.spam_rule_flags(df).collect()}
    wanted = {i: expected_rule(t) for i, t in enumerate(TEXTS)}
    assert got == wanted
    assert set(wanted.values()) == set(spam.RULES) | {None}
    verdict = {r["id"]: r["rule_spam"] for r in spam.spam_by_rule(df).collect()}
    assert verdict == {i: rule is not None for i, rule in wanted.items()}


def test_missing_model_score_counts_as_zero(spark):
    df = spark.createDataFrame(
        [("a nice long text", None), ("a nice long text", float("nan")), ("hi", 0.0), ("a nice long text", 0.3)],
        "commenttext string, p double",
    )
    rows = spam.detect_spam(df, model_score=F.col("p")).collect()
    assert [(r["spam_score"], r["is_spam"]) for r in rows] == [
        (0.0, False), (0.0, False), (1.0, True), (0.3, True)
    ]


def test_sentiment_of_empty_text_and_range(spark):
    df = spark.createDataFrame([("",), ("worst terrible",), ("love it",)], "commenttext string")
    rows = sentiment.sentiment(df).collect()
    assert [r["sentiment_label"] for r in rows] == ["POSITIVE", "NEGATIVE", "POSITIVE"]
    assert all(0.5 <= r["sentiment_score"] <= 1 for r in rows)


def expected_actionability(text):
    sums = {}
    for name, weight in R.WEIGHTS.items():
        hits = sum(k in text for k in R.KEYWORDS[name])
        hits += sum(bool(re.search(p, text)) for p in R.PATTERNS[name])
        sums[name] = weight * hits
    best = max(sums, key=sums.get)
    return sum(sums.values()), best if sums[best] else R.NO_CATEGORY


CLEANED = [
    "love serum", "buy now", "shipping take", "", "forget show", "must have highly recommend",
    "store location works good", "return policy", "obsessed look", "xyz qqq", "happy with it is great",
    "what is the price of", "worth it", "self-care with", "mail @me", "getting nothing", "totally agree",
    "épic is épic x is epic",
]


@pytest.mark.parametrize("automaton", [True, False])
def test_actionability_matches_plain_python(spark, automaton):
    df = spark.createDataFrame([(t,) for t in CLEANED], "text_cleaned string")
    scored = A.category_scores(df, automaton=automaton).select(
        "text_cleaned", A.actionability_score(), A.actionability_label()
    )
    assert {r[0]: (r[1], r[2]) for r in scored.collect()} == {t: expected_actionability(t) for t in CLEANED}


def test_every_pattern_contains_one_of_its_required_literals():
    samples = {"\\s+": " ", "(\\w+)": "word", "\\w+": "word"}
    for patterns in R.PATTERNS.values():
        for pattern in patterns:
            text = pattern
            for token, sample in samples.items():
                text = text.replace(token, sample)
            variants = [text]
            while any("(" in v for v in variants):
                variants = [v.replace(m.group(0), o, 1) for v in variants
                            for m in [re.search(r"\(([^()]*)\)", v)] for o in m.group(1).split("|")]
            for v in variants:
                assert re.search(pattern, v)
                assert any(x in v for x in A.required_literals(pattern) or [""]), (pattern, v)


def test_ties_go_to_the_earlier_category(spark):
    df = spark.createDataFrame([(0, 2, 2, 2), (3, 3, 0, 0), (0, 0, 0, 0)],
                               "purchase_intent long, product_feedback long, brand_advocacy long, customer_inquiry long")
    got = [r[0] for r in df.select(A.actionability_label()).collect()]
    assert got == ["Product Feedback", "Purchase Intent", "Not Actionable"]


def test_relevance_cap_and_bonus(spark):
    df = spark.createDataFrame([(0.95, ["a"], ["a"]), (-0.2, ["a"], ["b"]), (0.1, [], [])],
                               "c double, m array<string>, v array<string>")
    score = relevance.weighted_relevance(F.col("c"), relevance.hashtag_bonus(F.col("m"), F.col("v")))
    assert [round(r[0], 6) for r in df.select(score).collect()] == [1.0, -0.2, 0.1]


def test_relevance_routes(spark):
    videos = spark.createDataFrame(
        [("v1", "lipstick review", None, None), ("v2", None, None, None)],
        "videoid string, title string, description string, tags array<string>")
    comments = spark.createDataFrame(
        [("c1", "v1", "lipstick review"), ("c2", "v1", "!!"), ("c3", "v2", "lipstick"), ("c4", "v9", "x y"),
         ("c5", "v1", "unknown words")], "commentid string, videoid string, commenttext string")
    rows = relevance.relevance(relevance.preprocess_comments(comments), videos).collect()
    got = {r["commentid"]: (round(r["weighted_relevance"], 6), r["is_relevant"]) for r in rows}
    assert got == {"c1": (1.0, True), "c2": (0.0, False), "c3": (0.0, False), "c4": (0.0, False), "c5": (0.0, False)}


def test_resonance_by_hand(spark):
    df = spark.createDataFrame([
        ("c1", "v1", 4, 0.5, 10, "POSITIVE", 0.8), ("c2", "v1", 0, -0.1, 0, "NEGATIVE", 0.9),
        ("c3", "v2", 0, 0.0, 5, "NEUTRAL", 0.6), ("c4", None, 3, 0.0, 0, None, 0.6),
    ], "commentid string, videoid string, commentlikes long, weighted_relevance double, actionability_score long, "
       "sentiment_label string, sentiment_score double")
    got = {r["commentid"]: round(r["product_resonance_score"], 9) for r in prs.prs(df).collect()}
    assert got == {
        "c1": round(0.4 * 0.5 + 0.25 * 1 + 0.2 * 0.9 + 0.15 * 0.5, 9),  # likes are twice the mean
        "c2": round(0.4 * -0.1 + 0.2 * 0.05, 9),
        "c3": round(0.25 * 0.5 + 0.2 * 0.5, 9),  # 0/0 likes count as no influence
        "c4": round(0.2 * 0.5, 9),
    }


def test_no_actionable_comment_at_all(spark):
    df = spark.createDataFrame([(0,), (0,)], "actionability_score long")
    assert [r["actionability_part"] for r in prs.prs_actionability(df).collect()] == [0.0, 0.0]


def test_sql_guard(spark):
    cases = {
        "select 1": True, "  SELECT a FROM t UNION SELECT b FROM t": True, "SELECT updated FROM t": True,
        "SELECT 'update' FROM t": False, "WITH x AS (SELECT 1) SELECT * FROM x": False,
        "SELECT 1 UNION  ALL SELECT 2": False, "SELECT * FROM t WHERE 11 = 10": False, "drop table t": False,
    }
    assert {text: check_sql(spark, text)[0] for text in cases} == cases


def _comment_video(spark, comments, videos):
    comments = spark.createDataFrame(comments, "commentid string, videoid string, commenttext string")
    videos = spark.createDataFrame(videos, "videoid string, title string, description string, tags array<string>, publishedat string")
    return relevance.preprocess_comments(comments), videos


def test_relevance_without_any_video_text(spark):
    comments, videos = _comment_video(spark, [("c", "v", "nice serum")], [("v", "", None, [], "2024")])
    rows = relevance.relevance(comments, videos).collect()
    assert [(r["weighted_relevance"], r["is_relevant"]) for r in rows] == [(0.0, False)]
    assert relevance.rowwise_cosine(comments, relevance.with_video_text(videos)).first()["cosine"] is None


def test_a_video_with_two_texts_keeps_its_comments_single(spark):
    comments, videos = _comment_video(
        spark, [("c", "v", "red serum")], [("v", "blue cream", "", [], "2023"), ("v", "red serum", "", [], "2024")])
    assert [round(r["weighted_relevance"], 6) for r in relevance.relevance(comments, videos).collect()] == [1.0]
    cosines = relevance.rowwise_cosine(comments, relevance.with_video_text(videos)).collect()
    assert [round(r["cosine"], 6) for r in cosines] == [1.0]


def test_relevance_counts_every_word_of_a_large_vocabulary(spark):
    words = [f"w{i:05d}x" for i in range(60_000)]
    rare = " ".join(f"rare{i}" for i in range(3))
    videos = [(f"v{k}", " ".join(words[k * 1000:(k + 1) * 1000]), "", [], "2024") for k in range(60)]
    comments, videos = _comment_video(spark, [("c", "z", rare)], [*videos, ("z", rare, "", [], "2024")])
    assert round(relevance.relevance(comments, videos).first()["weighted_relevance"], 6) == 1.0


def test_tables_of_any_size(spark, apply):
    from resona.functions import text as T

    lemmas = {f"form{i}": f"lemma{i}" for i in range(10_000)}
    rows = spark.createDataFrame([(["Form9999", "form0", "other"],)], "t array<string>").select(T.lemmatize(F.col("t"), lemmas))
    assert rows.first()[0] == ["lemma9999", "lemma0", "other"]


def test_sentiment_shares_of_any_label(spark):
    from resona.operators.report import report_sentiment_dist

    df = spark.createDataFrame(
        [("v", "POSITIVE"), ("v", "MIXED"), ("v", "MIXED"), ("w", "MIXED"), ("w", None)], "videoid string, sentiment_label string")
    assert {tuple(r) for r in report_sentiment_dist(df).collect()} == {
        ("v", "POSITIVE", 1 / 3), ("v", "MIXED", 2 / 3), ("w", "MIXED", 1.0)}


def test_models_of_the_chain_can_be_swapped(spark, base):
    from resona.operators.clustering import ClusterModel
    from resona.operators.tfidf import TfidfModel
    from resona.plans.score import Scorers, score_comments
    from resona.sources import derived as D

    given = D.raw_comments(spark, base).limit(60).withColumns({
        "p_spam": F.when(F.col("commentlikes") % 2 == 0, 0.9).otherwise(0.0), "p_good": F.lit(0.8), "v": F.array(F.lit(1.0), F.lit(0.0))})
    videos = D.videos(spark, base).withColumn("v", F.array(F.lit(1.0), F.lit(1.0)))
    clusters = ClusterModel(TfidfModel([], []), [], [], [])
    scored = score_comments(given, videos, clusters, Scorers(F.col("p_spam"), F.col("p_good")), vector="v").collect()
    assert len(scored) == 60 and {r["cluster_label"] for r in scored} == {"others"}
    assert {r["sentiment_label"] for r in scored} == {"POSITIVE"} and {r["sentiment_score"] for r in scored} == {0.8}
    assert {r["spam_score"] for r in scored} <= {0.0, 0.9, 1.0} and {0.0, 0.9} <= {r["spam_score"] for r in scored}
    relevances = {round(r["weighted_relevance"], 6) for r in scored}
    assert relevances <= {0.0, round(0.5 ** 0.5, 6), round(0.5 ** 0.5 + 0.1, 6)} and len(relevances) > 1


def test_logits_in_batches_equal_those_by_columns(spark):
    from pyspark.sql import functions as F

    from resona.functions import linear, text as T

    texts = ["", None, "love LOVE worst", "éblove bad good", "see http://x.yz/love great-buy", "@love now", "  free\nwin  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.lower(T.clean_text_sentiment(F.col("t"))), "[^a-z0-9]+", " ")
    clean = T.clean_text_basic(F.col("t"))
    both = [
        (linear.text_logit(F.lower(T.without_links_and_mentions(F.col("t"))), linear.SENTIMENT_WEIGHTS, 0.25, plain=True),
         linear.logit(T.split_words(plain), linear.SENTIMENT_WEIGHTS, 0.25)),
        (linear.text_logit(clean, linear.SPAM_WEIGHTS, -2.0), linear.logit(T.split_words(clean), linear.SPAM_WEIGHTS, -2.0)),
        (linear.text_logit(F.col("t"), {"win": 1.0}, 0.0).isNull(), F.col("t").isNull()),
    ]
    for row in df.select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(both)]).collect():
        assert all(p.a == p.b for p in row)


def test_words_without_an_idf_are_not_shuffled_with_their_text(spark):
    from resona.operators import relevance as R

    df = spark.createDataFrame([(1, "a bb bb zz"), (1, "bb cc"), (2, None), (3, ""), (None, "cc")], "k int, t string")
    idf = spark.createDataFrame([("bb", 2.0), ("cc", 1.0)], "term string, idf double")
    met = R._raw_weights(df, ["k"], "t", idf)
    assert sorted((str(r.k), r.term, r.weight) for r in met.collect()) == [("1", "bb", 6.0), ("1", "cc", 1.0), ("None", "cc", 1.0)]
    lines = met._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [x for x in lines if "Join" in x or "Aggregate" in x][0].strip().startswith("Aggregate")
