"""Star schema: five dimensions, the video dimension, the comment fact and two bridges."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions import text as T
from resona.functions import video as V


def surrogate(text: Column) -> Column:
    """Stable id of a text; the same in every run and on every executor."""
    return F.md5(text)


def date_id(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def dim_author(authors: DataFrame, author: str = "authorid") -> DataFrame:
    return authors.select(F.col(author).alias("authorid")).where("authorid IS NOT NULL").distinct()


def dim_channel(videos: DataFrame) -> DataFrame:
    return videos.select("channelid").where("channelid IS NOT NULL").distinct()


def dim_date(*dates: DataFrame) -> DataFrame:
    """Calendar parts of every date in the given one-column frames. Monday is weekday 0."""
    days = reduce(DataFrame.unionByName, [d.toDF("date") for d in dates])
    d = F.col("date")
    return days.where(d.isNotNull()).distinct().select(
        date_id(d).alias("dateid"), d, F.year(d).alias("year"), F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"), F.weekday(d).alias("weekday"),
        F.date_format(d, "MMMM").alias("monthname"), F.quarter(d).alias("quarter"),
    )


def dim_hashtag(comments: DataFrame) -> DataFrame:
    tags = comments.select(F.explode("hashtags_comments").alias("hashtag")).distinct()
    return tags.select(surrogate(F.col("hashtag")).alias("hashtagid"), "hashtag")


def dim_topiccategory(videos: DataFrame) -> DataFrame:
    topics = videos.select(F.explode("topics").alias("topiccategory")).distinct()
    return topics.select(surrogate(F.col("topiccategory")).alias("topiccategoryid"), "topiccategory")


def prepare_videos(videos: DataFrame) -> DataFrame:
    """Typed columns of raw video records: dates, counts, length, topics, engagement rate."""
    counts = {c: V.coerce_int(F.col(c)) for c in ("viewcount", "likecount", "commentcount")}
    typed = videos.withColumns({
        **counts,
        "publishedat": V.coerce_date(F.col("publishedat")),
        "contentduration_seconds": V.iso_duration_seconds(F.col("duration")),
        "topics": V.topics_from_wiki_urls(F.col("topiccategory")),
    })
    rate = V.engagement_rate(F.col("likecount"), F.col("commentcount"), F.col("viewcount"))
    return typed.withColumn("engagement_rate", rate)


def dim_video(videos: DataFrame) -> DataFrame:
    """One row per video of prepared records."""
    return videos.dropDuplicates(["videoid"]).select(
        "videoid", "channelid", date_id(F.col("publishedat")).alias("dateid"), "viewcount",
        F.col("likecount").alias("likecount_video"), "commentcount", "engagement_rate",
        "contentduration_seconds",
    )


def fact_comments(scored: DataFrame) -> DataFrame:
    """One row per scored comment; categories in lower case, as the metrics expect them."""
    author = F.col("authorid") if "authorid" in scored.columns else F.lit(None).cast("string")
    return scored.select(
        "commentid", "videoid", author.alias("authorid"), "channelid",
        date_id(F.col("commentpublishedat")).alias("dateid"),
        F.col("commentlikes").alias("likecount_comment"),
        F.col("is_spam").cast("boolean").alias("is_spam"), "spam_score", "weighted_relevance",
        F.col("is_relevant").cast("boolean").alias("is_relevant"),
        F.lower("cluster_label").alias("cluster_label"), "sentiment_label", "sentiment_score",
        "actionability_label", F.col("actionability_score").cast("double").alias("actionability_score"),
        "product_resonance_score",
    )


def bridge_hashtag(comments: DataFrame) -> DataFrame:
    """(hashtag, video, comment). The id is a function of the tag, so the dimension is not joined."""
    tags = F.explode(F.array_distinct("hashtags_comments")).alias("hashtag")
    return comments.select("videoid", "commentid", tags).select(
        surrogate(F.col("hashtag")).alias("hashtagid"), "videoid", "commentid"
    ).distinct()


def bridge_topic_category(videos: DataFrame) -> DataFrame:
    topics = F.explode(F.array_distinct("topics")).alias("topiccategory")
    return videos.select("videoid", topics).select(
        surrogate(F.col("topiccategory")).alias("topiccategoryid"), "videoid"
    ).distinct()


def build_star(scored: DataFrame, videos: DataFrame) -> dict[str, DataFrame]:
    """All nine tables from scored comments and prepared video records."""
    with_tags = scored.withColumn("hashtags_comments", T.extract_hashtags(F.col("commenttext")))
    fact = fact_comments(scored)
    return {
        "dim_author": dim_author(fact),
        "dim_channel": dim_channel(videos.select("channelid").unionByName(scored.select("channelid"))),
        "dim_date": dim_date(videos.select("publishedat"), scored.select("commentpublishedat")),
        "dim_hashtag": dim_hashtag(with_tags),
        "dim_topiccategory": dim_topiccategory(videos),
        "dim_video": dim_video(videos),
        "fact_comments": fact,
        "bridge_hashtag": bridge_hashtag(with_tags),
        "bridge_topic_category": bridge_topic_category(videos),
    }
