"""Figures behind the report and the pages: counts, shares, histograms, sections."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions.text import strip
from resona.operators.kpi import share, value_shares

# Header words of a report section, in the order they are tried, and section names.
SECTIONS = [
    (["EXECUTIVE SUMMARY"], "executive_summary"),
    (["AUDIENCE INSIGHTS", "AUDIENCE"], "audience_insights"),
    (["PRODUCT ANALYSIS", "PRODUCT"], "product_analysis"),
    (["CONTENT PERFORMANCE", "CONTENT"], "content_performance"),
    (["RECOMMENDATIONS", "ACTIONABLE"], "recommendations"),
]

VIDEO_COLUMNS = [
    "videoid", "title", "description", "publishedat", "channelid", "tags", "viewcount", "likecount",
    "commentcount", "topiccategory", "contentduration_seconds", "hashtags_video", "emojis_video", "duration",
    "engagement_rate", "video_text",
]


def report_counts(df: DataFrame) -> DataFrame:
    spam = F.count_if("is_spam")
    return df.agg(
        F.count("*").alias("total_comments"),
        spam.alias("spam_count"),
        (F.count("*") - spam).alias("valid_comments"),
        (share(F.col("is_spam")) * 100).alias("spam_ratio"),
        F.avg("weighted_relevance").alias("avg_relevance"),
        F.avg("product_resonance_score").alias("avg_product_resonance"),
    )


def report_sentiment_dist(df: DataFrame) -> DataFrame:
    """Share of each sentiment within each video, whatever the labels. Counts per (video, label) come
    first; the totals are sums of those."""
    known = df.where(F.col("videoid").isNotNull() & F.col("sentiment_label").isNotNull())
    counts = known.groupBy("videoid", "sentiment_label").agg(F.count("*").alias("count"))
    totals = counts.groupBy("videoid").agg(F.sum("count").alias("n"))
    return counts.join(totals, "videoid").select(
        "videoid", "sentiment_label", (F.col("count") / F.col("n")).alias("share")
    )


def relevance_buckets(df: DataFrame) -> DataFrame:
    r = F.col("weighted_relevance")
    return df.agg(
        F.count_if(r > 0.7).alias("high"),
        F.count_if((r >= 0.3) & (r <= 0.7)).alias("medium"),
        F.count_if(r < 0.3).alias("low"),
    )


def category_distribution(df: DataFrame) -> DataFrame:
    return value_shares(df, "cluster_label")


def top3_categories(df: DataFrame, n: int = 3) -> DataFrame:
    known = df.where(F.col("cluster_label").isNotNull())
    counts = known.groupBy("cluster_label").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "cluster_label").limit(n)


def histogram(df: DataFrame, value: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins from the least to the greatest value, the last one closed; the edges are shared by
    all groups. Null values are left out, empty bins are not listed when grouped."""
    known = df.where(F.col(value).isNotNull())
    least, most = F.min(value).cast("double"), F.max(value).cast("double")
    half = F.when(least == most, 0.5).otherwise(0.0)  # one value only: a range of width 1 around it
    edges = known.agg(F.struct((least - half).alias("lo"), (most + half).alias("hi")).alias("e"))
    lo, hi = edges.scalar()["lo"], edges.scalar()["hi"]
    position = F.floor((F.col(value) - lo) / (hi - lo) * bins)
    counts = (
        known.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy(*by, "bin").agg(F.count("*").alias("count"))
    )
    if not by:
        all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counts = all_bins.join(counts, "bin", "left").na.fill(0, ["count"])
    width = (hi - lo) / bins
    return counts.select(
        *by, "bin", (lo + width * F.col("bin")).alias("bin_start"),
        (lo + width * (F.col("bin") + 1)).alias("bin_end"), "count",
    )


def relevance_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, "weighted_relevance", 10)


def prs_histogram_by_category(df: DataFrame, bins: int = 20) -> DataFrame:
    known = df.where(F.col("cluster_label").isNotNull())
    return histogram(known, "product_resonance_score", bins, ["cluster_label"])


def _section_number(line: Column) -> Column:
    """Number of the section a header line opens; -1 for a body line."""
    upper = F.upper(line)
    opened = [F.when(upper.rlike("|".join(marks)), i) for i, (marks, _) in enumerate(SECTIONS)]
    return F.coalesce(*opened, F.lit(-1))


def sectionize(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one text column per section of a report text (empty where a section has no line).

    A line that holds a header word, in any case, is a header: it opens that section and is dropped,
    even if it is prose that merely mentions the word. Lines before the first header belong to the
    executive summary. All of this stays within the row: the lines between two headers are one slice.
    """
    lines = F.filter(
        F.transform(F.split(text, "\n"), strip), lambda line: line != ""
    )
    numbered = df.withColumn("_lines", lines).withColumn(
        "_codes", F.transform("_lines", _section_number)
    )
    # 1-based positions of the headers, with a virtual one before the first line and after the last.
    heads = F.filter(
        F.transform("_codes", lambda code, i: F.when(code >= 0, i + 1)), lambda i: i.isNotNull()
    )
    framed = numbered.withColumn(
        "_heads", F.concat(F.array(F.lit(0)), heads, F.array(F.size("_lines") + 1))
    )
    spans = F.transform(
        F.sequence(F.lit(1), F.size("_heads") - 1),
        lambda j: F.struct(
            F.coalesce(F.get("_codes", F.get("_heads", j - 1) - 1), F.lit(0)).alias("section"),
            F.slice("_lines", F.get("_heads", j - 1) + 1,
                    F.get("_heads", j) - F.get("_heads", j - 1) - 1).alias("lines"),
        ),
    )
    spanned = framed.withColumn("_spans", spans)

    def section(number: int) -> Column:
        own = F.filter("_spans", lambda s: s["section"] == number)
        return F.array_join(F.flatten(F.transform(own, lambda s: s["lines"])), " ")

    return spanned.select(
        *df.columns, *[section(i).alias(name) for i, (_, name) in enumerate(SECTIONS)]
    )


def page_metrics(df: DataFrame) -> DataFrame:
    """The four cards of the analysis page. Percentages round half to even, as the page prints."""
    total, spam = F.count("*"), F.count_if("is_spam")

    def percent(part: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), total) * 100, F.lit(0.0))

    def whole(value: Column) -> Column:
        return F.bround(value, 0).cast("long").cast("string")

    return df.agg(
        total.alias("total_comments"),
        F.concat(whole(percent(total - spam)), F.lit(" : "), whole(percent(spam)))
        .alias("nonspam_spam_ratio"),
        F.bround(percent(F.count_if("is_relevant")), 2).alias("relevance_pct"),
        F.bround(F.coalesce(F.avg("product_resonance_score"), F.lit(0.0)), 2).alias("avg_prs"),
    )


def sentiment_share_by_category(df: DataFrame) -> DataFrame:
    """Positive and negative share of each category, over all its rows with a label."""
    known = df.where(F.col("cluster_label").isNotNull() & F.col("sentiment_label").isNotNull())
    return known.groupBy("cluster_label").agg(
        share(F.col("sentiment_label") == "POSITIVE").alias("positive"),
        share(F.col("sentiment_label") == "NEGATIVE").alias("negative"),
    )


def actionability_distribution(df: DataFrame) -> DataFrame:
    """Rows per label. Rows without one are left out by their count: a filter on the label would be pushed below the
    functions that make it, and run them twice."""
    label = "actionability_label"
    counts = df.groupBy(label).agg(F.count(label).alias("count")).where("count > 0")
    return counts.orderBy(F.desc("count"), "actionability_label")


def relevance_sentiment_points(df: DataFrame) -> DataFrame:
    return df.select("weighted_relevance", "sentiment_score", "cluster_label")


def comment_table(df: DataFrame) -> DataFrame:
    """The scored table without the columns of its video, `duration` among them."""
    return df.drop(*VIDEO_COLUMNS)
