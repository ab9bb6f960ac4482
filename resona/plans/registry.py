"""Every query by name: each takes (spark, folder of the given tables) and returns a frame."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import text as T
from resona.functions import video as V
from resona.functions import words as W
from resona.operators import actionability as A
from resona.operators import audit, clustering as K, kpi, prs, relevance as R
from resona.operators.dictionary import replace_tokens
from resona.operators import report, sentiment as SE, spam as SP, star, tfidf
from resona.plans import metrics
from resona.plans.catalogue import DESCRIPTIONS, GIVEN_REFERENCES, GIVEN_TABLES
from resona.plans.score import score_comments
from resona.plans.skew import salted_join
from resona.session import cut_lineage, new_path
from resona.sources import derived as D
from resona.sources import sink, threads, warehouse
from resona.sources.warehouse import spread, table

Query = Callable[[SparkSession, str], DataFrame]
TEXT = "commenttext"
SCORED_COLUMNS = [
    "commentid", "videoid", "channelid", "commentpublishedat", "commentlikes", "commenttext", "hashtags_comments",
    "emojis_comments", "spam_score", "is_spam", "weighted_relevance", "is_relevant", "sentiment_label", "sentiment_score",
    "actionability_score", "actionability_label", "cluster_label", "product_resonance_score",
]


def plain(df: DataFrame) -> DataFrame:
    """Result columns as they can be compared across engines: numbers to six places (by way of ten,
    so that the last bit of a sum cannot decide a tie), dates as text, flags as 0/1, lists as text."""
    shown = {
        "double": lambda c: F.floor(F.round(c, 10) * 1e6 + 0.5) / 1e6,
        "date": lambda c: c.cast("string"),
        "boolean": lambda c: c.cast("int"),
        "array<string>": lambda c: F.array_join(c, "|"),
    }
    return df.select(*[
        shown.get(f.dataType.simpleString(), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ])


# ---- inputs several queries share --------------------------------------------------------------


def _typed(s, d):
    return star.prepare_videos(D.videos(s, d))


def _described(s, d):
    return R.with_video_text(D.videos(s, d))


def _scored(s, d):
    return score_comments(D.comments(s, d).drop(
        "weighted_relevance", "sentiment_label", "sentiment_score", "actionability_score", "cluster_label"
    ), D.videos(s, d))


def _labelled(s, d):
    return D.comments(s, d).select("commentid", "cluster_label", "commenttext")


def _tokens(s, d):
    return K.cluster_preprocess(_labelled(s, d)).drop("commenttext")


def _vectors(s, d):
    """Stored, because fitting and the query itself read it; with the fitted model."""
    tokens = cut_lineage(_tokens(s, d))
    model = K.fit_terms(tokens)
    return K.add_vectors(tokens, model), model


def _filtered(s, d):
    tokens = cut_lineage(_tokens(s, d))
    model = K.fit_terms(tokens)
    kept = [r["term"] for r in K.kept_terms(tokens, model).select("term").collect()]
    return K.add_vectors(K.vocab_filter(tokens, kept), model), model


def _embeddings(s, d):
    return K.dense_features(table(s, d, "embeddings"), "embedding")


class _Star:
    """The star tables, each built when a metric first asks for it."""

    def __init__(self, s, d):
        self.source = (s, d)

    comments = cached_property(lambda self: D.star_comments(*self.source))
    videos = cached_property(lambda self: D.star_videos(*self.source))
    dates = cached_property(lambda self: D.star_dates(*self.source))
    topics = cached_property(lambda self: D.star_topic_bridge(*self.source))
    hashtag_uses = cached_property(lambda self: star.bridge_hashtag(_tagged(*self.source)))
    hashtags = cached_property(lambda self: star.dim_hashtag(_tagged(*self.source)))


class _StoredStar(_Star):
    """The same with the columns of the facts that metrics need stored once; what else comes from the facts is made of
    them."""

    comments = cached_property(lambda self: cut_lineage(D.star_comments(*self.source).select(
        "videoid", "commentid", "dateid", "cluster_label", "sentiment_label", "sentiment_score", "is_spam", "product_resonance_score",
        "topiccategoryid",
    )))
    dates = cached_property(lambda self: self.comments.select("dateid", F.col("dateid").alias("date")).distinct())
    topics = cached_property(lambda self: self.comments.select("topiccategoryid", "videoid").distinct())


def _per_comment(name: str, function: Callable[[Column], Column]) -> Query:
    return lambda s, d: D.raw_comments(s, d).select(
        "commentid", function(F.col(TEXT)).alias(name)
    )


def _on_star(metric: Callable[[metrics.Star], DataFrame]) -> Query:
    return lambda s, d: metric(_Star(s, d))


def _on_facts(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: metric(D.star_comments(s, d))


# ---- sources and sinks -------------------------------------------------------------------------


def dim_date(s, d):
    return star.dim_date(
        table(s, d, "lineitem").select(F.to_date("l_shipdate")),
        table(s, d, "orders").select(F.to_date("o_orderdate")),
    )


def _tagged(s, d):
    return D.raw_comments(s, d).withColumn("hashtags_comments", T.extract_hashtags(F.col(TEXT)))


def fk_audit(s, d):
    def ref(child, column, parent, parent_column):
        return (f"{child}.{column}", table(s, d, child), column, table(s, d, parent), parent_column)

    return audit.fk_audit([
        ref("labels", "doc_id", "documents", "doc_id"),
        ref("embeddings", "vec_id", "documents", "doc_id"),
        ref("events", "event_id", "documents", "doc_id"),
        ref("events", "user_id", "customer", "c_custkey"),
        ref("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ref("lineitem", "l_partkey", "part", "p_partkey"),
    ])


def catalog_describe(s, d):
    tables = {name: table(s, d, name) for name in GIVEN_TABLES}
    return audit.catalog_describe(s, tables, GIVEN_REFERENCES, DESCRIPTIONS)


def adhoc_sql(s, d):
    names = ("customer", "orders", "lineitem")
    return warehouse.adhoc_sql(s, """
        SELECT c_custkey, c_name, count(*) AS n_lines, sum(l_extendedprice) AS revenue
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 10
    """, {name: table(s, d, name) for name in names})


def write_scored(s, d):
    """The whole chain, written twice under one run name and read back: one copy."""
    path, scored = new_path(s, "scored"), cut_lineage(_scored(s, d))
    for _ in range(2):
        sink.write_scored(scored, path, "query")
    return sink.read_scored(s, path).select(*SCORED_COLUMNS)


SOURCES = {
    "flatten_threads": lambda s, d: threads.flatten_threads(threads.parse_pages(D.page_texts(s, d))),
    "video_without_comments": lambda s, d: threads.videos_with_comments(
        D.videos(s, d), D.raw_comments(s, d)
    ).select("videoid", "title", "commentid", "commentlikes"),
    "table_scan": lambda s, d: warehouse.table_scan(
        D.star_videos(s, d), ["videoid", "channelid", "likecount_video"]
    ),
    "exact_count": _on_facts(warehouse.exact_count),
    "dim_author": lambda s, d: star.dim_author(table(s, d, "conversations"), "role"),
    "dim_channel": lambda s, d: star.dim_channel(D.videos(s, d)),
    "dim_date": dim_date,
    "dim_hashtag": lambda s, d: star.dim_hashtag(_tagged(s, d)),
    "dim_topiccategory": lambda s, d: star.dim_topiccategory(_typed(s, d)),
    "dim_video": lambda s, d: star.dim_video(_typed(s, d)),
    "fact_comments": lambda s, d: star.fact_comments(_scored(s, d)),
    "bridge_hashtag": lambda s, d: star.bridge_hashtag(_tagged(s, d)),
    "bridge_topic_category": lambda s, d: star.bridge_topic_category(_typed(s, d)),
    "pk_audit": lambda s, d: audit.pk_audit(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "fk_audit": fk_audit,
    "catalog_describe": catalog_describe,
    "adhoc_sql": adhoc_sql,
    "sql_log_audit": lambda s, d: audit.sql_log_audit(D.sql_log(s, d)),
    "preview": lambda s, d: warehouse.preview(D.star_videos(s, d), ["videoid"], 10),
    "write_scored": write_scored,
}

# ---- scalar functions --------------------------------------------------------------------------


def topic_from_wiki_url(s, d):
    topics = F.col("topiccategory")
    as_text = F.when(F.size(topics) == 0, "[]").otherwise(
        F.concat(F.lit("['"), F.array_join(topics, "', '"), F.lit("']"))
    )
    return D.videos(s, d).select(
        "videoid", V.topics_from_wiki_urls(topics).alias("topics"),
        V.topics_from_wiki_text(as_text).alias("topics_of_text"),
        F.array_join(V.topics_from_wiki_text(F.get(topics, 0)), "|").alias("topic_of_first"),
    )


def boost_terms(s, d):
    vectors, model = _vectors(s, d)
    non_empty = vectors.where(F.size("tokens") > 0)
    return tfidf.corpus_term_scores(non_empty, model, T.boost_terms, minimum=0.0)


def lemmatize_by_table(s, d):
    forms, tags = D.word_forms(s, d)
    documents = spread(table(s, d, "documents")).select("doc_id", F.filter(
        F.split(F.lower("text"), r"[^a-z]+"), lambda t: t != "").alias("tokens"))
    return replace_tokens(documents, "doc_id", forms, tags=tags).select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"))


FUNCTIONS = {
    "video_id_from_url": lambda s, d: D.links(s, d).withColumn(
        "video_id", V.video_id_from_url(F.col("url"))
    ),
    "embed_id_from_url": lambda s, d: D.links(s, d).withColumn(
        "video_id", V.embed_id_from_url(F.col("url"))
    ),
    "iso_duration_seconds": lambda s, d: D.durations(s, d).withColumn(
        "seconds", V.iso_duration_seconds(F.col("duration"))
    ),
    "topic_from_wiki_url": topic_from_wiki_url,
    "coerce_dates": lambda s, d: D.date_texts(s, d).withColumn("date", V.coerce_date(F.col("t"))),
    "coerce_ints": lambda s, d: D.number_texts(s, d).withColumn("n", V.coerce_int(F.col("t"))),
    "combined_video_text": lambda s, d: D.videos(s, d).select("videoid", V.combined_video_text(
        F.col("title"), F.col("description"), F.col("tags")
    ).alias("combined")),
    "extract_hashtags": _per_comment("hashtags", T.extract_hashtags),
    "extract_emojis": _per_comment("emojis", T.extract_emojis),
    "clean_text_basic": _per_comment("cleaned", T.clean_text_basic),
    "clean_text_sentiment": _per_comment("cleaned", T.clean_text_sentiment),
    "clean_text_actionability": _per_comment("cleaned", T.clean_text_actionability),
    "demojize": _per_comment("spelled", T.demojize),
    "remove_stopwords": lambda s, d: spread(table(s, d, "documents")).select(
        "doc_id", F.array_join(T.remove_stopwords(
            T.split_words(F.lower("text")), W.ENGLISH_STOP_WORDS), " ").alias("kept")
    ),
    "engagement_rate": lambda s, d: D.videos(s, d).select("videoid", V.engagement_rate(
        F.col("likecount"), F.col("commentcount"), F.col("viewcount")
    ).alias("engagement_rate")),
    "clean_text_cluster": _per_comment("cleaned", T.clean_text_cluster),
    "tokenize_reduce": _per_comment("tokens", lambda c: F.array_join(
        T.tokenize_reduce(T.clean_text_cluster(c)), " ")),
    "expand_slang": _per_comment("tokens", lambda c: F.array_join(
        T.expand_slang(T.split_words(F.lower(c))), " ")),
    "token_filters": _per_comment("tokens", lambda c: F.array_join(T.drop_meaningless_tokens(
        T.drop_short_tokens(T.split_words(F.lower(c)))), " ")),
    "lemmatize": _per_comment("tokens", lambda c: F.array_join(
        T.lemmatize(T.split_words(F.lower(c))), " ")),
    "demojize_sequences": lambda s, d: D.emoji_comments(s, d).select(
        "commentid", T.demojize(F.col(TEXT)).alias("spelled")
    ),
    "lemmatize_by_table": lemmatize_by_table,
    "too_short_flag": lambda s, d: _tokens(s, d).select(
        "commentid", T.too_short(F.col("textcleaned")).alias("too_short")
    ),
    "boost_terms": boost_terms,
}

# ---- spam, relevance, sentiment, actionability -------------------------------------------------


def _with_probability(s, d, label):
    """Documents with the probability `p` of a model trained on the labelled ones among them."""
    documents = spread(table(s, d, "documents")).select("doc_id", "text")
    labelled = cut_lineage(documents.join(table(s, d, "labels").select("doc_id", label), "doc_id"))
    model = SP.train_text_classifier(labelled, "text", label)
    return SP.apply_text_classifier(model, documents, "p")


def spam_model_trained(s, d):
    documents = _with_probability(s, d, "toxic")
    return SP.detect_spam(documents, "text", model_score=F.col("p")).select(
        "doc_id", "spam_score", "is_spam"
    )


def sentiment_trained(s, d):
    documents = _with_probability(s, d, "quality")
    return SE.sentiment(documents, probability=F.col("p")).drop("p", "text")


def text_embedding(s, d):
    texts = R.distinct_video_texts(_described(s, d))
    return R.embed(texts, ["videoid"], "video_text", R.fit_idf(texts))


def text_embedding_word2vec(s, d):
    documents = spread(table(s, d, "documents")).select(
        "doc_id", T.clean_text_basic(F.col("text")).alias("clean")
    )
    return R.embed_dense(documents, "clean", "vector").select(
        "doc_id", F.size(tfidf.values(F.col("vector"))).alias("dimensions"),
        F.aggregate(tfidf.values(F.col("vector")), F.lit(0.0), lambda a, x: a + x * x).alias("norm2"),
    )


def rowwise_cosine(s, d):
    comments = R.preprocess_comments(D.raw_comments(s, d))
    return R.rowwise_cosine(comments, _described(s, d)).select("commentid", "cosine")


def hashtag_overlap_bonus(s, d):
    comments = R.preprocess_comments(D.raw_comments(s, d)).select(
        "commentid", "videoid", "hashtags_comments"
    )
    videos = _described(s, d).select("videoid", "hashtags_video")
    joined = salted_join(comments, videos, "videoid", "commentid")
    return joined.select("commentid", R.hashtag_bonus(
        F.col("hashtags_comments"), F.col("hashtags_video")
    ).alias("bonus"))


def _relevance(s, d):
    return R.relevance(R.preprocess_comments(D.raw_comments(s, d)), D.videos(s, d))


def relevance_routing(s, d):
    """Videos without views are taken to have no text, so that every route occurs."""
    seen = F.col("viewcount") > 0
    videos = D.videos(s, d).withColumns({
        c: F.when(seen, F.col(c)) for c in ("title", "description", "tags")
    })
    return R.relevance(R.preprocess_comments(D.raw_comments(s, d)), videos).select(
        "commentid", "weighted_relevance", "is_relevant"
    )


def relevance_of_vectors(s, d):
    """Every embedding is the vector of a comment, the first fifty are those of the videos too; labels are hashtags."""
    given = table(s, d, "embeddings").select(
        F.col("vec_id").alias("commentid"), (F.col("vec_id") % 50).alias("videoid"), "embedding",
        F.array(F.col("label").cast("string")).alias("tags"))
    videos = given.where(F.col("commentid") < 50)
    measured = R.cosine_of_vectors(given, videos)
    tagged = measured.join(videos.select("videoid", F.col("tags").alias("theirs")), "videoid", "left")
    score = R.weighted_relevance(F.col("cosine"), R.hashtag_bonus(F.col("tags"), F.col("theirs")))
    return tagged.select("commentid", "cosine", score.alias("weighted_relevance"))


def _action_clean(s, d):
    return D.raw_comments(s, d).select(
        "commentid", T.clean_text_actionability(F.col(TEXT)).alias("text_cleaned")
    )


def _action(s, d):
    return A.actionability(D.raw_comments(s, d).select("commentid", "commenttext"))


SCORING = {
    "spam_rule_flags": lambda s, d: SP.spam_rule_flags(
        D.raw_comments(s, d).select("commentid", "commenttext")
    ).drop("commenttext"),
    "spam_model_score": _per_comment("spam_score", SP.spam_model_score),
    "spam_model_trained": spam_model_trained,
    "spam_final": lambda s, d: SP.detect_spam(D.raw_comments(s, d)).select(
        "commentid", "spam_score", "is_spam"
    ),
    "distinct_video_texts": lambda s, d: R.distinct_video_texts(_described(s, d)),
    "text_embedding": text_embedding,
    "text_embedding_word2vec": text_embedding_word2vec,
    "rowwise_cosine": rowwise_cosine,
    "hashtag_overlap_bonus": hashtag_overlap_bonus,
    "weighted_relevance": lambda s, d: _relevance(s, d).select("commentid", "weighted_relevance"),
    "is_relevant": lambda s, d: _relevance(s, d).groupBy("videoid").agg(
        F.count_if("is_relevant").alias("relevant"), F.count("*").alias("comments")
    ),
    "relevance_routing": relevance_routing,
    "relevance_of_vectors": relevance_of_vectors,
    "sentiment": lambda s, d: SE.sentiment(D.raw_comments(s, d)).select(
        "commentid", "sentiment_label", "sentiment_score"
    ),
    "sentiment_trained": sentiment_trained,
    "rule_keyword_hits": lambda s, d: A.rule_keyword_hits(_action_clean(s, d)).drop("text_cleaned"),
    "rule_regex_hits": lambda s, d: A.rule_regex_hits(_action_clean(s, d)).drop("text_cleaned"),
    "actionability_score": lambda s, d: _action(s, d).select("commentid", "actionability_score"),
    "actionability_label": lambda s, d: _action(s, d).select("commentid", "actionability_label"),
    "actionability": lambda s, d: _action(s, d).drop("commenttext"),
}

# ---- clustering --------------------------------------------------------------------------------


def tfidf_1_2grams(s, d):
    vectors, model = _vectors(s, d)
    return tfidf.term_weights(vectors, ["commentid"], model)


def corpus_term_scores(s, d):
    vectors, model = _vectors(s, d)
    return tfidf.corpus_term_scores(vectors.where(F.size("tokens") > 0), model, T.boost_terms)


def _valid_vectors(s, d):
    filtered, model = _filtered(s, d)
    return cut_lineage(filtered.where(K.valid_row())), model


def _distinct_texts(s, d):
    filtered, model = _filtered(s, d)
    return cut_lineage(K.distinct_texts(filtered.where(K.valid_row()), model))


def kmeans(s, d):
    texts = _distinct_texts(s, d)
    model = K.fit_kmeans(texts, [3], "textcleaned", weight="weight")[3]
    return K.kmeans_assign(texts, K.centre_rows(s, model)).select("textcleaned", "weight", "cluster")


def kmeans_of_vectors(s, d):
    vectors = _embeddings(s, d)
    model = K.fit_kmeans(vectors, [3], "vec_id")[3]
    return K.kmeans_assign(vectors, K.centre_rows(s, model)).select("vec_id", "cluster")


def kmeans_assign(s, d):
    vectors = _embeddings(s, d)
    return K.kmeans_assign(
        vectors.select("vec_id", "features"),
        K.centroids(vectors, "label").withColumnRenamed("label", "cluster"),
    ).select("vec_id", "cluster")


def silhouette(s, d):
    return s.createDataFrame([(K.silhouette(_embeddings(s, d), "label"),)], "silhouette double")


def choose_k(s, d):
    rows, _ = K.choose_k(_distinct_texts(s, d), "textcleaned", weight="weight", n_rows=_tokens(s, d).count())
    return s.createDataFrame(rows, "k int, score double, chosen boolean")


def invalid_to_other(s, d):
    filtered, _ = _filtered(s, d)
    return filtered.select(
        "commentid", F.when(K.valid_row(), F.col("cluster_label")).otherwise(K.OTHERS).alias("label")
    )


def cluster_top_terms(s, d):
    vectors, model = _valid_vectors(s, d)
    return K.cluster_top_terms(vectors, model, "cluster_label")


def cluster_keyphrases_mmr(s, d):
    vectors, model = _valid_vectors(s, d)
    return K.cluster_keyphrases(vectors, model, "cluster_label")


def cluster_profile(s, d):
    vectors, model = _valid_vectors(s, d)
    return K.cluster_profile(vectors, model, "commentid", "cluster_label", phrases=False)


def _labels(s, d):
    filtered, model = _filtered(s, d)
    stored = cut_lineage(filtered.drop("tokens"))
    chosen = K.cluster_representatives(stored.where(K.valid_row()), "commentid", "cluster_label")
    return stored, K.label_clusters(chosen, model, "cluster_label")


def apply_cluster_label(s, d):
    stored, labels = _labels(s, d)
    rows = stored.select(
        "commentid", F.when(K.valid_row(), F.col("cluster_label")).alias("cluster")
    )
    named = K.apply_cluster_label(rows, labels.withColumnRenamed("cluster_label", "cluster"))
    return named.select("commentid", "cluster_label")


CLUSTERING = {
    "cluster_preprocess": lambda s, d: _tokens(s, d).select("commentid", "textcleaned"),
    "tfidf_1_2grams": tfidf_1_2grams,
    "corpus_term_scores": corpus_term_scores,
    "vocab_filter": lambda s, d: _filtered(s, d)[0].select("commentid", "textcleaned"),
    "valid_row_mask": lambda s, d: _filtered(s, d)[0].where(K.valid_row()).select(
        "commentid", "textcleaned"
    ),
    "kmeans": kmeans,
    "kmeans_of_vectors": kmeans_of_vectors,
    "kmeans_assign": kmeans_assign,
    "silhouette": silhouette,
    "choose_k": choose_k,
    "invalid_to_other": invalid_to_other,
    "cluster_sizes": lambda s, d: K.cluster_sizes(
        _filtered(s, d)[0].where(K.valid_row()), "cluster_label"
    ),
    "cluster_top_terms": cluster_top_terms,
    "cluster_keyphrases_mmr": cluster_keyphrases_mmr,
    "cluster_representatives": lambda s, d: K.cluster_representatives(
        _embeddings(s, d), "vec_id", "label"
    ).select("label", "vec_id", "rank", "distance"),
    "cluster_profile": cluster_profile,
    "label_cluster": lambda s, d: _labels(s, d)[1],
    "apply_cluster_label": apply_cluster_label,
    "product_clusters": lambda s, d: K.product_clusters(
        D.raw_comments(s, d).select("commentid", "commenttext")
    ).select("commentid", "cluster_label"),
}

# ---- resonance score, metrics, report ----------------------------------------------------------


def score_comments_query(s, d):
    return _scored(s, d).select(
        "commentid", "spam_score", "is_spam", "weighted_relevance", "is_relevant",
        "sentiment_label", "sentiment_score", "actionability_score", "actionability_label",
        "cluster_label", "product_resonance_score",
    )


def _one_part(column: str) -> Query:
    return lambda s, d: prs.prs(D.comments(s, d)).select("commentid", column)


RESONANCE = {
    "prs_actionability": lambda s, d: prs.prs_actionability(D.comments(s, d)).select(
        "commentid", "actionability_part"
    ),
    "prs_sentiment": lambda s, d: D.comments(s, d).select("commentid", prs.prs_sentiment(
        F.col("sentiment_label"), F.col("sentiment_score")
    ).alias("sentiment_part")),
    "prs_influence": lambda s, d: prs.prs_influence(D.comments(s, d)).select(
        "commentid", "influence_part"
    ),
    "prs": _one_part("product_resonance_score"),
    "score_comments": score_comments_query,
}

METRIC_QUERIES = dict(zip(
    [
        "kpi_total_videos", "kpi_avg_engagement", "kpi_avg_prs", "kpi_quality_comment_ratio",
        "engagement_vs_prs", "avg_by_duration", "top_liked_category", "topic_distribution",
        "kpi_total_comments", "kpi_spam_ratio", "kpi_comment_quality_pct", "kpi_sentiment_ratio",
        "top_hashtags", "avg_prs_by_category", "category_sentiment", "category_trend",
    ],
    [_on_star(metric.run) for metric in metrics.METRICS.values()],
)) | {"metric_catalogue": lambda s, d: metrics.metric_catalogue(_StoredStar(s, d))}


def comment_table(s, d):
    videos = D.videos(s, d).drop("channelid")
    return report.comment_table(salted_join(_scored(s, d), videos, "videoid", "commentid"))


REPORT = {
    "report_counts": _on_facts(report.report_counts),
    "report_sentiment_dist": _on_facts(report.report_sentiment_dist),
    "relevance_buckets": _on_facts(report.relevance_buckets),
    "category_distribution": _on_facts(report.category_distribution),
    "top3_categories": _on_facts(report.top3_categories),
    "relevance_histogram": _on_facts(report.relevance_histogram),
    "sectionize": lambda s, d: report.sectionize(D.report_texts(s, d)).drop("text"),
    "page_metrics": _on_facts(report.page_metrics),
    "sentiment_share_by_category": _on_facts(report.sentiment_share_by_category),
    "actionability_distribution": lambda s, d: report.actionability_distribution(_action(s, d)),
    "prs_histogram_by_category": _on_facts(report.prs_histogram_by_category),
    "relevance_sentiment_points": _on_facts(report.relevance_sentiment_points),
    "comment_table": comment_table,
}


def registry() -> dict[str, Query]:
    groups = [SOURCES, FUNCTIONS, SCORING, CLUSTERING, RESONANCE, METRIC_QUERIES, REPORT]

    def shown(run: Query) -> Query:
        return lambda spark, base: plain(run(spark, base))

    return {name: shown(run) for group in groups for name, run in group.items()}


def mean_resonance_by_category(spark: SparkSession, base: str) -> DataFrame:
    """The flagship: the whole scoring chain, then mean score per given product category."""
    return plain(kpi.avg_prs_by_category(_scored(spark, base)))
