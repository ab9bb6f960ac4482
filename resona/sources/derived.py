"""Comments, videos and star tables derived from the given TPC-H-like tables.

Every function reads whole tables: each event is one comment, each document is attached whole to
one comment, each user is one video, each order line is one scored comment of the star schema.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.sources.warehouse import spread, table

PHRASES = [
    "where can i buy this foundation online",
    "i love this serum so much",
    "this lipstick is amazing 😍 #makeup",
    "how long does shipping take to canada",
    "my hair feels better after using this shampoo 💇",
    "check http://deals.example.com now",
    "@anna great texture of this cream #SkinCare #skincare",
    "worst mascara ever, terrible quality",
    "omg obsessed with this look",
    "hi",
    "?! :) ;) !! -- .. a",
    "aaaaaaaaaaaaaa",
    " ".join(["buy"] * 12),
    "the price of this toner?",
    "holy grail eyeliner, highly recommend #beauty",
    "𝐁𝐔𝐘𝐍𝐎𝐖" * 5,
    "@a @b @c @d @e @f look at this",
    "",
    " ".join(["buy now"] * 6),
    "return policy for the primer please",
    "crème légère pour les cheveux #été",
    "need it, want it, link to the store",
    " ".join(["lovely serum"] * 45),
    "tbh idk if this concealer is better 😂😂",
]
CATEGORIES = [
    "Cosmetics (Eye & Lip)", "Hair treatment", "Make Up", "Physical appearance", "Skin care",
    "others",
]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def comments(spark: SparkSession, base: str) -> DataFrame:
    """One comment per event; the document with the event's number is appended whole."""
    e = spread(table(spark, base, "events"))
    d = table(spark, base, "documents").select(F.col("doc_id").alias("event_id"), "text")
    i = F.col("event_id")
    kind = F.col("event_type")
    return e.join(d, "event_id", "left").select(
        F.concat(F.lit("c"), i).alias("commentid"),
        F.concat(F.lit("v"), F.col("user_id")).alias("videoid"),
        F.concat(F.lit("ch"), F.col("user_id") % 12).alias("channelid"),
        F.to_date("ts").alias("commentpublishedat"),
        F.floor("value").cast("long").alias("commentlikes"),
        F.concat(
            pick(PHRASES, i % len(PHRASES)),
            F.when(i % 5 == 0, F.concat(F.lit(" #"), kind)).otherwise(""),
            F.coalesce(F.concat(F.lit(" "), F.col("text")), F.lit("")),
        ).alias("commenttext"),
        pick(CATEGORIES, i % 6).alias("cluster_label"),
        F.when(kind.isin("purchase", "signup"), "POSITIVE").when(kind == "error", "NEGATIVE")
        .otherwise("NEUTRAL").alias("sentiment_label"),
        ((50 + (i * 37) % 50) / F.lit(100.0)).alias("sentiment_score"),
        F.least(((i * 53) % 140 - 20) / F.lit(100.0), F.lit(1.0)).alias("weighted_relevance"),
        ((i * 7) % 23).alias("actionability_score"),
    )


SEQUENCES = ["👍🏽", "🇫🇷", "👩‍💻", "1️⃣", "👍🏽👍", "🇫🇷🇩🇪", "❤️", "👩🏿‍💻😍", "💇‍♀️ #1", ""]


def emoji_comments(spark: SparkSession, base: str) -> DataFrame:
    """Comments with an emoji of several code points, or two neighbours, behind the text."""
    e = table(spark, base, "events")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("c"), i).alias("commentid"),
        F.concat(pick(PHRASES, i % len(PHRASES)), F.lit(" "), pick(SEQUENCES, i % len(SEQUENCES))).alias("commenttext"),
    )


def word_forms(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """A dictionary of all words of the documents, (token, pos, form) and (token, pos): verbs lose `ed`, nouns lose a
    last `s`; as nouns the verbs would have another form."""
    text = F.lower("text")
    words = spread(table(spark, base, "documents")).select(F.explode(F.split(text, r"[^a-z]+")).alias("token")).distinct()
    verbs, nouns = F.col("token").rlike("^[a-z]{2,}ed$"), F.col("token").rlike("^[a-z]{3,}s$")
    verb = words.where(verbs).select("token", F.lit("v").alias("pos"), F.regexp_replace("token", "ed$", "").alias("form"))
    other = words.where(verbs).select("token", F.lit("n").alias("pos"), F.lit("wrong").alias("form"))
    noun = words.where(nouns).select("token", F.lit("n").alias("pos"), F.regexp_replace("token", "s$", "").alias("form"))
    return verb.unionByName(other).unionByName(noun), verb.select("token", "pos")


COMMENT_COLUMNS = [
    "commentid", "videoid", "channelid", "commentpublishedat", "commentlikes", "commenttext",
]


def raw_comments(spark: SparkSession, base: str) -> DataFrame:
    """Comments without the given scores."""
    return comments(spark, base).select(*COMMENT_COLUMNS)


def videos(spark: SparkSession, base: str) -> DataFrame:
    """One video record per user, described by a whole benchmark text, and one without comments."""
    e = table(spark, base, "events")
    b = table(spark, base, "benchmark").select("item_id", F.col("text").alias("about"))
    n_items = b.agg(F.count("*").alias("n"))
    per_user = e.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"),
        F.sum(F.floor("value")).cast("long").alias("points"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count("*").alias("events"),
    ).withColumn("item_id", F.col("user_id") % n_items.scalar())
    u = F.col("user_id")
    wiki = "https://en.wikipedia.org/wiki/"
    empty = F.array().cast("array<string>")
    found = per_user.join(b, "item_id", "left").select(
        F.concat(F.lit("v"), u).alias("videoid"),
        F.concat(F.lit("Video "), u, F.lit(" "),
                 pick(["makeup tutorial", "skin care routine", "hair repair tips"], u % 3))
        .alias("title"),
        F.concat(
            F.col("about"), F.lit(" #"), pick(["makeup", "skincare", "beauty"], u % 3),
            F.when(u % 4 == 0, " https://shop.example.com/a 😍").otherwise(""),
        ).alias("description"),
        F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedat"),
        F.concat(F.lit("ch"), u % 12).alias("channelid"),
        F.when(u % 5 == 0, empty)
        .otherwise(F.array(F.lit("review"), pick(["makeup", "skincare", "hair"], u % 3)))
        .alias("tags"),
        F.when(u % 6 == 0, F.concat(F.lit("PT"), u % 12, F.lit("M"), (u * 7) % 60, F.lit("S")))
        .when(u % 6 == 1, F.concat(F.lit("PT1H"), u % 60, F.lit("M")))
        .when(u % 6 == 2, "P1DT2H").when(u % 6 == 3, "P1M").when(u % 6 == 4, "bad")
        .otherwise(F.concat(F.lit("PT"), u, F.lit("S"))).alias("duration"),
        F.when(u % 10 == 0, 0).otherwise(F.col("points") * 10).cast("long").alias("viewcount"),
        F.col("clicks").alias("likecount"),
        F.col("events").alias("commentcount"),
        F.when(u % 7 == 0, empty).otherwise(F.array(
            F.concat(F.lit(wiki), pick(["Lifestyle", "Fashion", "Health"], u % 3)),
            F.lit(wiki + "Beauty"), F.lit("https://example.org/other"),
        )).alias("topiccategory"),
    )
    quiet = spark.createDataFrame(
        [("v_none", "Quiet video", None, "not a date", "ch0", [], "PT5S", 10, 0, 0, [])],
        found.schema,
    )
    return found.unionByName(quiet)


def page_texts(spark: SparkSession, base: str) -> DataFrame:
    """Each document as one landed JSON page: its lines are threads, the sentences after the first
    one of a line are the replies."""
    d = spread(table(spark, base, "documents"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
                   F.lit("T10:00:00Z"))

    def snippet(text: Column, likes: Column) -> Column:
        return F.struct(text.alias("textOriginal"), day.alias("publishedAt"),
                        likes.cast("long").alias("likeCount"))

    def item(line: Column, i: Column) -> Column:
        item_id = F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), i)
        parts = F.split(line, r"\. ")
        replies = F.transform(
            F.slice(parts, 2, F.size(parts)),
            lambda r, j: F.struct(F.concat(item_id, F.lit("."), j).alias("id"),
                                  snippet(r, j).alias("snippet")),
        )
        return F.struct(
            item_id.alias("id"),
            F.struct(
                (F.size(parts) - 1).cast("long").alias("totalReplyCount"),
                F.struct(snippet(F.element_at(parts, 1), F.length(line)).alias("snippet"))
                .alias("topLevelComment"),
            ).alias("snippet"),
            replies.alias("replies"),
        )

    return d.select(F.to_json(F.struct(
        F.concat(F.lit("p"), F.col("doc_id")).alias("videoId"),
        F.transform(F.split("text", "\n"), item).alias("items"),
    )).alias("page"))


# ---- star tables at the scale of lineitem ------------------------------------------------------


def star_videos(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    return o.select(
        F.col("o_orderkey").alias("videoid"),
        F.col("o_custkey").alias("channelid"),
        F.floor("o_totalprice").cast("long").alias("likecount_video"),
        (F.col("o_totalprice") / 500000.0).alias("engagement_rate"),
        ((F.col("o_orderkey") * 13) % 600).alias("contentduration_seconds"),
    )


def star_comments(spark: SparkSession, base: str) -> DataFrame:
    """One scored comment per order line."""
    line = table(spark, base, "lineitem")
    p = table(spark, base, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    kind, flag, status = F.col("p_type"), F.col("l_returnflag"), F.col("l_linestatus")
    category = (
        F.when(kind == "MEDIUM", "make up").when(kind == "STANDARD", "skin care")
        .when(kind == "PROMO", "hair treatment").when(kind == "ECONOMY", "cosmetics (eye & lip)")
        .when(kind == "SMALL", "physical appearance").otherwise("others")
    )
    sentiment = (
        F.when(flag == "A", "POSITIVE").when(flag == "R", "NEGATIVE")
        .when((flag == "N") & (status == "O"), "NEUTRAL")
    )
    return line.join(p, "l_partkey").select(
        F.col("l_orderkey").alias("videoid"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("commentid"),
        F.to_date("l_shipdate").alias("dateid"),
        category.alias("cluster_label"),
        sentiment.alias("sentiment_label"),
        (F.col("l_quantity") / 50).alias("sentiment_score"),
        (F.col("l_quantity") / 50).alias("weighted_relevance"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") * 10 + 0.0).alias("product_resonance_score"),
        (status == "F").alias("is_spam"),
        (F.col("l_quantity") / 50 >= 0.3).alias("is_relevant"),
        F.col("p_brand").alias("topiccategoryid"),
    )


def star_dates(spark: SparkSession, base: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, base, "lineitem").select(day.alias("dateid"), day.alias("date")).distinct()


def star_topic_bridge(spark: SparkSession, base: str) -> DataFrame:
    return star_comments(spark, base).select("topiccategoryid", "videoid").distinct()


# ---- texts of other kinds ----------------------------------------------------------------------


def links(spark: SparkSession, base: str) -> DataFrame:
    """Every page's link and eight other shapes built from the page."""
    page = F.col("page_id")
    item = F.lpad(page.cast("string"), 11, "Ab-_")
    shapes = F.array(
        F.col("url"),
        F.concat(F.lit("https://www.example.com/watch?v="), item, F.lit("&t=5")),
        F.concat(F.col("url"), F.lit("&v=a%20b+c#v=x")),
        F.concat(F.lit("https://youtu.be/"), item),
        F.concat(F.lit("https://www.example.com/shorts/"), item, F.lit(";p=1?x="), page),
        F.concat(F.lit("https://www.example.com/embed/"), item),
        F.lit("https://www.example.com/shorts/"),
        F.lit("no id"),
        F.concat(F.lit("https://www.example.com/watch?v=&v="), item),
    )
    return table(spark, base, "pages").select("page_id", F.explode(shapes).alias("url"))


def _by_case(index: Column, cases: list[Column]) -> Column:
    """The case with the number of the index; null beyond the last one."""
    return F.get(F.array(*cases), index.cast("int"))


def durations(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id")
    shapes = [
        F.concat(F.lit("PT"), i % 24, F.lit("H"), i % 60, F.lit("M"), i % 59, F.lit("S")),
        F.concat(F.lit("P"), i % 9, F.lit("DT"), i % 24, F.lit("H")),
        F.concat(F.lit("P"), i % 7, F.lit("M")),
        F.concat(F.lit("PT"), i, F.lit("S")),
        i.cast("string"),
        F.concat(F.lit("P"), i % 5, F.lit("W")),
        F.concat(F.lit("P"), i % 3, F.lit("DT")),
        F.concat(F.lit("PT"), i % 50, F.lit("M")),
    ]
    return table(spark, base, "events").select(i, _by_case(i % 9, shapes).alias("duration"))


def date_texts(spark: SparkSession, base: str) -> DataFrame:
    i, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    shapes = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        day,
        F.concat(F.lit("on "), day),
        F.date_format("ts", "yyyy-'13'-dd"),
    ]
    return table(spark, base, "events").select(i, _by_case(i % 6, shapes).alias("t"))


def number_texts(spark: SparkSession, base: str) -> DataFrame:
    i, whole = F.col("event_id"), F.floor("value").cast("string")
    shapes = [
        whole, F.concat(whole, F.lit(".9")), F.lit("n/a"), F.concat(F.lit("-"), whole), F.lit(""),
    ]
    return table(spark, base, "events").select(i, _by_case(i % 6, shapes).alias("t"))


def sql_log(spark: SparkSession, base: str) -> DataFrame:
    """One logged SQL text per event."""
    i, u = F.col("event_id"), F.col("user_id")
    shapes = [
        F.concat(F.lit("SELECT * FROM fact WHERE user_id = "), u),
        F.concat(F.lit(" select count(*) from fact where likes > "), i),
        F.concat(F.lit("DROP TABLE t"), i),
        F.concat(F.lit("SELECT 'update' FROM t"), i),
        F.concat(F.lit("WITH x AS (SELECT "), i, F.lit(") SELECT * FROM x")),
        F.concat(F.lit("SELECT 1 UNION ALL SELECT "), i),
        F.concat(F.lit("SELECT * FROM t WHERE 11 = 10 AND id = "), i),
        F.concat(F.lit("SELECT updated FROM t LIMIT "), i),
        F.concat(F.lit("SELECT 1 UNION SELECT "), i),
        F.concat(F.lit("delete from t where id = "), i),
        F.concat(F.lit("SELECT * FROM t WHERE a = "), u, F.lit(" or 1 = 1")),
        F.col("event_type"),
    ]
    return table(spark, base, "events").select(i, _by_case(i % 12, shapes).alias("query_text"))


def report_texts(spark: SparkSession, base: str) -> DataFrame:
    """Every document as a report: its whole text under two headers, with further sections."""
    text, lang = F.col("text"), F.col("lang")
    lines = [
        F.lit("EXECUTIVE SUMMARY"), text, F.lit("Audience insights:"), lang,
        F.concat(F.lit("  "), F.col("source")), F.lit("PRODUCT ANALYSIS"), text,
        F.lit("these contents are lost"), lang, F.lit("Actionable steps"),
        F.col("n_chars").cast("string"),
    ]
    return spread(table(spark, base, "documents")).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
