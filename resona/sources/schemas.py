"""Schemas of the inputs and of the nine warehouse tables, with their keys."""

from pyspark.sql import types as T

_COMMENT = T.StructType([
    T.StructField("textOriginal", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("likeCount", T.LongType()),
])
_REPLY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("snippet", _COMMENT),
])

# One landed page of comment threads of one video.
THREAD_PAGE = T.StructType([
    T.StructField("videoId", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("totalReplyCount", T.LongType()),
            T.StructField("topLevelComment", T.StructType([T.StructField("snippet", _COMMENT)])),
        ])),
        T.StructField("replies", T.ArrayType(_REPLY)),
    ]))),
])

VIDEO_RECORD = T.StructType([
    T.StructField("videoid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("publishedat", T.StringType()),
    T.StructField("channelid", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("duration", T.StringType()),
    T.StructField("viewcount", T.LongType()),
    T.StructField("likecount", T.LongType()),
    T.StructField("commentcount", T.LongType()),
    T.StructField("topiccategory", T.ArrayType(T.StringType())),
])

# Warehouse tables: DDL column lists (lower-case names throughout).
WAREHOUSE = {
    "dim_author": "authorid string",
    "dim_channel": "channelid string",
    "dim_date": (
        "dateid string, date date, year int, month int, day int, weekday int, "
        "monthname string, quarter int"
    ),
    "dim_hashtag": "hashtagid string, hashtag string",
    "dim_topiccategory": "topiccategoryid string, topiccategory string",
    "dim_video": (
        "videoid string, channelid string, dateid string, viewcount bigint, "
        "likecount_video bigint, commentcount bigint, engagement_rate double, "
        "contentduration_seconds double"
    ),
    "fact_comments": (
        "commentid string, videoid string, authorid string, channelid string, dateid string, "
        "likecount_comment bigint, is_spam boolean, spam_score double, "
        "weighted_relevance double, is_relevant boolean, cluster_label string, "
        "sentiment_label string, sentiment_score double, actionability_label string, "
        "actionability_score double, product_resonance_score double"
    ),
    "bridge_hashtag": "hashtagid string, videoid string, commentid string",
    "bridge_topic_category": "topiccategoryid string, videoid string",
}

PRIMARY_KEYS = {
    "dim_author": ["authorid"],
    "dim_channel": ["channelid"],
    "dim_date": ["dateid"],
    "dim_hashtag": ["hashtagid"],
    "dim_topiccategory": ["topiccategoryid"],
    "dim_video": ["videoid"],
    "fact_comments": ["commentid"],
    "bridge_hashtag": ["hashtagid", "videoid", "commentid"],
    "bridge_topic_category": ["topiccategoryid", "videoid"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("dim_video", "channelid", "dim_channel", "channelid"),
    ("dim_video", "dateid", "dim_date", "dateid"),
    ("fact_comments", "videoid", "dim_video", "videoid"),
    ("fact_comments", "authorid", "dim_author", "authorid"),
    ("fact_comments", "channelid", "dim_channel", "channelid"),
    ("fact_comments", "dateid", "dim_date", "dateid"),
    ("bridge_hashtag", "hashtagid", "dim_hashtag", "hashtagid"),
    ("bridge_hashtag", "videoid", "dim_video", "videoid"),
    ("bridge_hashtag", "commentid", "fact_comments", "commentid"),
    ("bridge_topic_category", "topiccategoryid", "dim_topiccategory", "topiccategoryid"),
    ("bridge_topic_category", "videoid", "dim_video", "videoid"),
]
