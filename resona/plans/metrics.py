"""All dashboard metrics by name, alone or as one long table."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.operators import kpi
from resona.session import cut_lineage


@dataclass
class Star:
    """The tables the metrics read."""

    comments: DataFrame
    videos: DataFrame
    dates: DataFrame
    topics: DataFrame
    hashtag_uses: DataFrame
    hashtags: DataFrame


@dataclass
class Metric:
    """How a metric is computed, and which of its columns are keys; the others are numbers."""

    run: Callable[[Star], DataFrame]
    keys: tuple[str, ...] = ()


# Metric names of the dashboards.
METRICS: dict[str, Metric] = {
    "KPI: Total Video Analyzed": Metric(lambda s: kpi.kpi_total_videos(s.videos)),
    "KPI: Average Engagement Rate": Metric(lambda s: kpi.kpi_avg_engagement(s.videos)),
    "KPI: Average PRS Score": Metric(lambda s: kpi.kpi_avg_prs(s.comments)),
    "KPI: Video Quality Comments Ratio": Metric(lambda s: kpi.kpi_quality_comment_ratio(s.comments)),
    "Chart: Engagement Rate VS Product Resonance Score":
        Metric(lambda s: kpi.engagement_vs_prs(s.comments, s.videos)),
    "Chart: Average SoE Metric by Content Duration": Metric(
        lambda s: kpi.avg_by_duration(kpi.per_video(s.comments), s.videos), ("contentduration_seconds",)),
    "Chart: Top Liked Product Category Content": Metric(
        lambda s: kpi.top_liked_category(kpi.per_video(s.comments), s.videos), ("channelid",)),
    "Chart: Video Topic Category Distribution": Metric(lambda s: kpi.topic_distribution(s.topics), ("topiccategoryid",)),
    "KPI: Total Comments Analyzed": Metric(lambda s: kpi.kpi_total_comments(s.comments)),
    "KPI: Comment Spam Ratio": Metric(lambda s: kpi.kpi_spam_ratio(s.comments)),
    "KPI: Comment Quality (%)": Metric(lambda s: kpi.kpi_comment_quality_pct(s.comments)),
    "KPI: Comments Sentiment Ratio": Metric(lambda s: kpi.kpi_sentiment_ratio(s.comments), ("sentiment_label",)),
    "Chart: Top 15 Most Trendy Hashtags": Metric(lambda s: kpi.top_hashtags(s.hashtag_uses, s.hashtags), ("hashtag",)),
    "Chart: Average PRS by Product Category": Metric(lambda s: kpi.avg_prs_by_category(s.comments), ("cluster_label",)),
    "Chart: Product Category Sentiment Breakdown": Metric(
        lambda s: kpi.category_sentiment(s.comments), ("cluster_label", "sentiment_label")),
    "Chart: Product Category Trend Distribution": Metric(
        lambda s: kpi.category_trend(s.comments, s.dates), ("cluster_label", "date")),
}


def fetch_metric(name: str, star: Star) -> DataFrame | None:
    """The result of one metric; None for an unknown name."""
    metric = METRICS.get(name)
    return metric.run(star) if metric else None


def _long(name: str, df: DataFrame) -> DataFrame:
    """(metric, key, measure, value): the numbers of a result beside its keys."""
    keys = METRICS[name].keys
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    values = F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").cast("double").alias("value"))
        for n in df.columns if n not in keys
    ])
    return df.select(F.lit(name).alias("metric"), key.alias("key"), F.inline(values))


BY_DAY = ["cluster_label", "sentiment_label", "dateid"]
BY_VIDEO = ["cluster_label", "videoid"]


def fact_sums(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sums that all metrics of comments are made of, from one scan: per category, sentiment and day, and per
    category and video. Both are grouping sets of one aggregation, which is stored."""
    prs = F.col("product_resonance_score")
    columns = [*BY_DAY, "videoid"]
    grouped = comments.groupingSets([[F.col(c) for c in BY_DAY], [F.col(c) for c in BY_VIDEO]], *columns).agg(
        F.grouping("videoid").alias("of_days"),
        F.count("*").alias("n"), F.count_if("is_spam").alias("spam"),
        F.count_if(F.col("sentiment_score") >= kpi.QUALITY_SENTIMENT).alias("good"),
        F.sum(prs).alias("prs"), F.count(prs).alias("n_prs"),
        F.count_if(prs >= kpi.QUALITY_PRS).alias("quality"),
    )
    stored = cut_lineage(grouped)
    days = stored.where("of_days = 1").drop("of_days", "videoid")
    videos = stored.where("of_days = 0 AND videoid IS NOT NULL").select(*BY_VIDEO, "n", "prs", "n_prs")
    return days, videos


def _comment_metrics(days: DataFrame) -> dict[str, DataFrame]:
    """The metrics that need sums over comments only, from those by category, sentiment and day."""

    def ratio(part: str, whole: str, scale: float = 1.0) -> Column:
        return F.coalesce(F.try_divide(F.sum(part) * scale, F.sum(whole)), F.lit(0.0))

    by_category = days.where("cluster_label IS NOT NULL").groupBy("cluster_label")
    labelled = days.where("sentiment_label IS NOT NULL")
    labels_total = labelled.agg(F.sum("n").alias("n")).scalar()
    return {
        "KPI: Average PRS Score": days.agg(ratio("prs", "n_prs").alias("avg_prs")),
        "KPI: Video Quality Comments Ratio":
            days.agg(ratio("quality", "n_prs").alias("quality_comment_ratio")),
        "KPI: Total Comments Analyzed":
            days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_comments")),
        "KPI: Comment Spam Ratio": days.agg(ratio("spam", "n").alias("spam_ratio")),
        "KPI: Comment Quality (%)": days.agg(ratio("good", "n", 100.0).alias("comment_quality_pct")),
        "KPI: Comments Sentiment Ratio": labelled.groupBy("sentiment_label").agg(
            (F.sum("n") / labels_total).alias("share")
        ),
        "Chart: Average PRS by Product Category": by_category.agg(
            F.try_divide(F.sum("prs"), F.sum("n_prs")).alias("avg_prs")
        ),
        "Chart: Product Category Sentiment Breakdown": labelled.where("cluster_label IS NOT NULL")
        .groupBy("cluster_label", "sentiment_label").agg(F.sum("n").alias("count")),
    }


def metric_catalogue(star: Star) -> DataFrame:
    """Every metric as one long table (metric, key, measure, value), the chart that lists every comment among them.

    The comments are read twice: for the sums by day and by video, and for that chart.
    """
    days, videos = fact_sums(star.comments)
    shared = _comment_metrics(days)
    shared["Chart: Product Category Trend Distribution"] = kpi.sum_trend(days, star.dates)
    shared["Chart: Average SoE Metric by Content Duration"] = kpi.avg_by_duration(videos, star.videos)
    shared["Chart: Top Liked Product Category Content"] = kpi.top_liked_category(videos, star.videos)
    return reduce(DataFrame.unionByName, [
        _long(name, shared[name] if name in shared else metric.run(star))
        for name, metric in METRICS.items()
    ])
