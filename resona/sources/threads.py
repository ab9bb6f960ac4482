"""Comment threads: nested pages in, one row per comment out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import video as V
from resona.plans.skew import salted_join
from resona.sources.schemas import THREAD_PAGE, VIDEO_RECORD


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages, with a fixed schema (no inference pass)."""
    return spark.read.schema(THREAD_PAGE).json(path)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON video records."""
    return spark.read.schema(VIDEO_RECORD).json(path)


def parse_pages(pages: DataFrame, column: str = "page") -> DataFrame:
    """Pages held as JSON text in a column."""
    return pages.select(F.from_json(column, THREAD_PAGE).alias("p")).select("p.*")


def flatten_threads(pages: DataFrame) -> DataFrame:
    """One row per top-level comment and one per reply, in one pass and without a shuffle.

    Replies are read only where the thread says it has any.
    """

    def comment(comment_id: Column, snippet: Column) -> Column:
        return F.struct(
            comment_id.alias("commentid"),
            snippet["textOriginal"].alias("commenttext"),
            snippet["publishedAt"].alias("commentpublishedat"),
            snippet["likeCount"].alias("commentlikes"),
        )

    def thread(item: Column) -> Column:
        top = F.array(comment(item["id"], item["snippet"]["topLevelComment"]["snippet"]))
        replies = F.transform(item["replies"], lambda r: comment(r["id"], r["snippet"]))
        return F.when(
            (item["snippet"]["totalReplyCount"] > 0) & item["replies"].isNotNull(),
            F.concat(top, replies),
        ).otherwise(top)

    rows = pages.select(
        F.col("videoId").alias("videoid"),
        F.inline(F.flatten(F.transform("items", thread))),
    )
    return rows.withColumns({
        "commentpublishedat": V.coerce_date(F.col("commentpublishedat")),
        "commentlikes": V.coerce_int(F.col("commentlikes")),
    })


def videos_with_comments(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Every video with its comments; a video without any keeps one row with null comment fields.

    Written as two joins, because the comments of a hot video can be spread over tasks in an inner
    join with the comments on the left, but not on the right of an outer join.
    """
    columns = ["videoid", *[c for c in videos.columns if c != "videoid"]]
    fields = [c for c in comments.columns if c not in columns]
    matched = salted_join(
        comments.select("videoid", *fields), videos.select(*columns), "videoid", "commentid"
    )
    silent = videos.join(comments.select("videoid").distinct(), "videoid", "left_anti")
    return matched.select(*columns, *fields).unionByName(
        silent.select(*columns), allowMissingColumns=True
    )
