"""The sixteen dashboard metrics over the star schema.

Averages skip nulls; groups with a null key are left out; empty input gives 0.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.plans.skew import salted_join

# The product categories of the category chart, in its column order.
CHART_CATEGORIES = [
    "cosmetics (eye & lip)", "hair treatment", "make up", "physical appearance", "skin care",
]
QUALITY_PRS = 0.3
QUALITY_SENTIMENT = 0.7


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def share(condition: Column, whole: Column | None = None) -> Column:
    """Rows where the condition holds, over all rows (or over the given count); 0 without rows."""
    total = F.count("*") if whole is None else whole
    return _or_zero(F.try_divide(F.count_if(condition).cast("double"), total))


def kpi_total_videos(videos: DataFrame) -> DataFrame:
    return videos.agg(F.count("*").alias("total_videos"))


def kpi_avg_engagement(videos: DataFrame) -> DataFrame:
    return videos.agg(_or_zero(F.avg("engagement_rate")).alias("avg_engagement_rate"))


def kpi_avg_prs(comments: DataFrame) -> DataFrame:
    return comments.agg(_or_zero(F.avg("product_resonance_score")).alias("avg_prs"))


def kpi_quality_comment_ratio(comments: DataFrame) -> DataFrame:
    prs = F.col("product_resonance_score")
    return comments.agg(share(prs >= QUALITY_PRS, F.count(prs)).alias("quality_comment_ratio"))


def engagement_vs_prs(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Engagement rate of the video beside the score of each of its comments."""
    pairs = salted_join(
        comments.select("videoid", "commentid", "product_resonance_score"),
        videos.select("videoid", "engagement_rate"),
        "videoid", "commentid",
    )
    return pairs.select("engagement_rate", "product_resonance_score")


def per_video(comments: DataFrame) -> DataFrame:
    """(videoid, cluster_label, n, prs, n_prs): comments and score sums. One row per video and
    category is what the charts join with the videos, however many comments a video has."""
    prs = F.col("product_resonance_score")
    return comments.where(F.col("videoid").isNotNull()).groupBy("videoid", "cluster_label").agg(
        F.count("*").alias("n"), F.sum(prs).alias("prs"), F.count(prs).alias("n_prs")
    )


def avg_by_duration(sums: DataFrame, videos: DataFrame) -> DataFrame:
    """Means per video length over comments, so a video weighs as much as it has comments.
    `sums` comes from `per_video`."""
    joined = sums.join(videos, "videoid").where(F.col("contentduration_seconds").isNotNull())
    rate = F.col("engagement_rate")
    return (
        joined.groupBy("contentduration_seconds").agg(
            F.try_divide(F.sum(rate * F.col("n")),
                         F.sum(F.when(rate.isNotNull(), F.col("n")))).alias("avg_engagement"),
            F.try_divide(F.sum("prs"), F.sum("n_prs")).alias("avg_prs"),
        ).orderBy("contentduration_seconds")
    )


def top_liked_category(sums: DataFrame, videos: DataFrame, n: int = 10) -> DataFrame:
    """Likes by category for the n channels with most video likes; a video's likes count once per
    comment. Only channels with a comment in one of the categories appear, best first. `sums` comes
    from `per_video`."""
    top = (
        videos.where(F.col("channelid").isNotNull())
        .groupBy("channelid").agg(F.sum("likecount_video").alias("likes"))
        .orderBy(F.desc("likes"), "channelid").limit(n)
    )
    their_videos = videos.join(F.broadcast(top), "channelid", "left_semi").select(
        "videoid", "channelid", "likecount_video"
    )
    pivoted = (
        their_videos.join(sums.where(F.col("cluster_label").isin(CHART_CATEGORIES)), "videoid")
        .groupBy("channelid").pivot("cluster_label", CHART_CATEGORIES)
        .agg(F.sum(F.col("likecount_video") * F.col("n")))
        .na.fill(0)
    )
    total = sum((F.col(f"`{c}`") for c in CHART_CATEGORIES), F.lit(0))
    return pivoted.orderBy(total.desc(), "channelid")


def topic_distribution(bridge: DataFrame, n: int = 5) -> DataFrame:
    return (
        bridge.where(F.col("topiccategoryid").isNotNull()).groupBy("topiccategoryid")
        .agg(F.countDistinct("videoid").alias("total_videos"))
        .orderBy(F.desc("total_videos"), "topiccategoryid").limit(n)
    )


def kpi_total_comments(comments: DataFrame) -> DataFrame:
    return comments.agg(F.count("*").alias("total_comments"))


def kpi_spam_ratio(comments: DataFrame) -> DataFrame:
    return comments.agg(share(F.col("is_spam")).alias("spam_ratio"))


def kpi_comment_quality_pct(comments: DataFrame) -> DataFrame:
    good = F.col("sentiment_score") >= QUALITY_SENTIMENT
    return comments.agg((share(good) * 100).alias("comment_quality_pct"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each non-null value. The total is a scalar subquery, not a window."""
    known = df.where(F.col(column).isNotNull())
    total = known.agg(F.count("*").cast("double").alias("n"))
    return known.groupBy(column).agg((F.count("*") / total.scalar()).alias("share"))


def kpi_sentiment_ratio(comments: DataFrame) -> DataFrame:
    return value_shares(comments, "sentiment_label")


def top_hashtags(bridge: DataFrame, hashtags: DataFrame, n: int = 15) -> DataFrame:
    """Uses per hashtag, most used first. Uses are counted per id before the join."""
    uses = bridge.where(F.col("hashtagid").isNotNull()).groupBy("hashtagid").agg(
        F.count("*").alias("uses")
    )
    return (
        uses.join(hashtags, "hashtagid").groupBy("hashtag").agg(F.sum("uses").alias("count"))
        .orderBy(F.desc("count"), "hashtag").limit(n)
    )


def avg_prs_by_category(comments: DataFrame) -> DataFrame:
    return (
        comments.where(F.col("cluster_label").isNotNull()).groupBy("cluster_label")
        .agg(F.avg("product_resonance_score").alias("avg_prs"))
        .orderBy(F.desc("avg_prs"), "cluster_label")
    )


def category_sentiment(comments: DataFrame) -> DataFrame:
    return (
        comments.where(F.col("cluster_label").isNotNull() & F.col("sentiment_label").isNotNull())
        .groupBy("cluster_label", "sentiment_label").agg(F.count("*").alias("count"))
    )


def sum_trend(per_day: DataFrame, dates: DataFrame) -> DataFrame:
    """Comments per category and day from counts `n` per category and date id."""
    known = per_day.where(F.col("cluster_label").isNotNull() & F.col("dateid").isNotNull())
    return (
        known.join(dates.select("dateid", "date"), "dateid")
        .groupBy("cluster_label", "date").agg(F.sum("n").alias("total_comments"))
        .orderBy("cluster_label", "date")
    )


def category_trend(comments: DataFrame, dates: DataFrame) -> DataFrame:
    """Comments per category and day. Counted per date id before the join with the date table."""
    per_day = comments.groupBy("cluster_label", "dateid").agg(F.count("*").alias("n"))
    return sum_trend(per_day, dates)
