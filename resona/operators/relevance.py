"""Relevance of each comment to its own video: cosine of text vectors plus a hashtag bonus."""

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.functions.text import clean_text_basic, extract_hashtags, split_words
from resona.functions.video import combined_video_text
from resona.operators import tfidf, wordvectors
from resona.plans.skew import salted_join
from resona.session import cut_lineage

THRESHOLD = 0.3
HASHTAG_BONUS = 0.10


def with_video_text(videos: DataFrame) -> DataFrame:
    """Add `hashtags_video` and the cleaned `video_text` of title, description and tags."""
    combined = combined_video_text(F.col("title"), F.col("description"), F.col("tags"))
    return videos.withColumns({
        "hashtags_video": extract_hashtags(combined),
        "video_text": clean_text_basic(combined),
    })


def preprocess_comments(comments: DataFrame, text: str = "commenttext") -> DataFrame:
    """Add `hashtags_comments` and `comment_clean`."""
    return comments.withColumns({
        "hashtags_comments": extract_hashtags(F.col(text)),
        "comment_clean": clean_text_basic(F.col(text)),
    })


def distinct_video_texts(videos: DataFrame) -> DataFrame:
    """Each video text once, blank ones left out, so that none is embedded twice."""
    return (
        videos.select("videoid", "video_text").dropDuplicates(["videoid", "video_text"])
        .where(F.trim("video_text") != "")
    )


def _words(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(…keys, term): every word of two and more characters."""
    return df.select(*keys, F.explode(tfidf.ngrams(split_words(F.col(text)), (1,))).alias("term"))


def fit_idf(video_texts: DataFrame) -> DataFrame:
    """(term, idf) over all words of the distinct video texts, as a stored table of any size."""
    n_docs = video_texts.agg(F.count("*").alias("n"))
    words = _words(video_texts, ["videoid", "video_text"], "video_text").distinct()
    counted = words.groupBy("term").agg(F.count("*").alias("df"))
    return cut_lineage(
        counted.select("term", (F.log((n_docs.scalar() + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )


def embed(df: DataFrame, keys: Sequence[str], text: str, idf: DataFrame) -> DataFrame:
    """(…keys, term, weight): the unit-length TF-IDF vector of each text, as rows; words without an
    idf are left out."""
    raw = _raw_weights(df, keys, text, idf)
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(*keys)))
    return raw.withColumn("weight", F.col("weight") / norm)


def _raw_weights(df: DataFrame, keys: Sequence[str], text: str, idf: DataFrame) -> DataFrame:
    """Words are counted per text before they meet their idf, so a frequent word is shuffled once per text, and words
    without an idf go before rows of equal keys are added up."""
    counted = df.select(*keys, F.inline(tfidf.word_counts(F.col(text))))
    met = counted.join(idf, "term").groupBy(*keys, "term", "idf").agg(F.sum("tf").alias("_tf"))
    return met.select(*keys, "term", (F.col("_tf") * F.col("idf")).alias("weight"))


def embed_dense(
    df: DataFrame, text: str, output: str, size: int = 32, parts: int = 8, min_count: int = 1
) -> DataFrame:
    """The other embedding: mean of word vectors trained on the same texts (see `wordvectors`).

    Words that occur fewer than `min_count` times have no vector and count as zeros. The texts are trained in at
    least `parts` parts; neither the driver nor a task holds the whole vocabulary.
    """
    found = wordvectors.embedded(df, text, output, size, parts, min_count)
    return found.withColumn(output, array_to_vector(F.col(output)))


def one_text(videos: DataFrame) -> DataFrame:
    """One row per video that has a text; of several the last by publishing date, then by text."""
    order = [c for c in ("publishedat", "video_text") if c in videos.columns]
    kept = F.struct("video_text", *[c for c in ("hashtags_video",) if c in videos.columns])
    return (
        videos.where(F.trim("video_text") != "").groupBy("videoid")
        .agg(F.max_by(kept, F.struct(*order)).alias("kept")).select("videoid", "kept.*")
    )


def cosines(comments: DataFrame, texts: DataFrame, idf: DataFrame) -> DataFrame:
    """(commentid, cosine) of comments that share a word with their video.

    Words meet by (videoid, term), so a video with very many comments is spread by its words, and the
    work grows with the words of the comments, not with its square.
    """
    mine = _raw_weights(comments, ["commentid", "videoid"], "comment_clean", idf)
    theirs = embed(texts, ["videoid"], "video_text", idf).withColumnRenamed("weight", "_video")
    both = mine.join(theirs, ["videoid", "term"], "left")
    summed = both.groupBy("commentid").agg(
        F.sum(F.col("weight") * F.col("_video")).alias("dot"), F.sum(F.col("weight") ** 2).alias("square"))
    return summed.where(F.col("dot").isNotNull()).select(
        "commentid", (F.col("dot") / F.sqrt("square")).alias("cosine"))


def rowwise_cosine(
    comments: DataFrame, videos: DataFrame, idf: DataFrame | None = None
) -> DataFrame:
    """Add `cosine` of each comment with its own video (null if that video has no text).

    `comments` need `comment_clean`, `videos` need `video_text`; commentid is their key.
    """
    idf = idf or fit_idf(distinct_video_texts(videos))
    texts = one_text(videos)
    found = cosines(comments, texts, idf).withColumnRenamed("cosine", "_cosine")
    joined = salted_join(
        comments, texts.select("videoid", F.lit(True).alias("_text")), "videoid", "commentid", "left")
    similarity = F.when(F.col("_text"), F.coalesce("_cosine", F.lit(0.0)))
    return joined.join(found, "commentid", "left").withColumn("cosine", similarity).drop("_text", "_cosine")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit_vector(vector: Column) -> Column:
    """The vector at length 1; null for a null or zero vector and one with a component that is missing."""
    exact = vector.cast("array<double>")
    length = F.sqrt(_dot(exact, exact))
    return F.when(length > 0, F.transform(exact, lambda x: x / length))


def cosine_of_vectors(
    comments: DataFrame, videos: DataFrame, vector: str = "embedding", histogram: DataFrame | None = None,
) -> DataFrame:
    """Add `cosine` of each comment's vector with that of its own video, both given as arrays in the column `vector`; null
    without one of them. Each video's unit vector (of several the least) is joined by its id, hot videos spread, and
    the product is made in place."""
    sides = videos.select("videoid", unit_vector(F.col(vector)).alias("_unit")).where(F.col("_unit").isNotNull())
    one = sides.groupBy("videoid").agg(F.min("_unit").alias("_unit"))
    joined = salted_join(comments, one, "videoid", "commentid", "left", histogram=histogram)
    return joined.withColumn("cosine", _dot(unit_vector(F.col(vector)), F.col("_unit"))).drop("_unit")


def hashtag_bonus(mine: Column, theirs: Column, bonus: float = HASHTAG_BONUS) -> Column:
    return F.when(F.arrays_overlap(mine, theirs), bonus).otherwise(0.0)


def weighted_relevance(
    cosine_: Column, bonus: Column, sem_weight: float = 1.0, max_score: float = 1.0
) -> Column:
    """Capped above only: a negative cosine stays negative."""
    return F.least(F.lit(sem_weight) * cosine_ + bonus, F.lit(max_score))


def relevance(
    comments: DataFrame,
    videos: DataFrame,
    sem_weight: float = 1.0,
    bonus: float = HASHTAG_BONUS,
    max_score: float = 1.0,
    threshold: float = THRESHOLD,
    idf: DataFrame | None = None,
    histogram: DataFrame | None = None,
    vector: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add `weighted_relevance` and `is_relevant`; blank comments and comments of videos without
    text get 0, also if no video has a text. `comments` come from `preprocess_comments`; `histogram` are their
    rows per video (`key_histogram`), if they were counted before.
    With `vector`, a column of given embeddings in both tables, the cosine is theirs instead of that of the words. With
    `keep` only these columns of the comments and their ids travel through the joins and come back."""
    described = with_video_text(videos)
    texts = cut_lineage(one_text(described))
    if vector:
        given = cosine_of_vectors(comments.select("commentid", "videoid", vector), videos, vector, histogram)
        found = given.select("commentid", F.col("cosine").alias("_cosine"))
    else:
        idf = idf or fit_idf(distinct_video_texts(described))
        found = cosines(comments, texts, idf).withColumnRenamed("cosine", "_cosine")
    video_side = texts.select("videoid", "hashtags_video", F.lit(True).alias("_text"))
    rows = comments.withColumn("_said", F.col("comment_clean") != "")
    if keep is not None:
        rows = rows.select(*dict.fromkeys(["commentid", "videoid", "hashtags_comments", "_said", *keep]))
    joined = salted_join(rows, video_side, "videoid", "commentid", "left", histogram=histogram)
    joined = joined.join(found, "commentid", "left")
    score = weighted_relevance(
        F.coalesce("_cosine", F.lit(0.0)),
        hashtag_bonus(F.col("hashtags_comments"), F.col("hashtags_video"), bonus),
        sem_weight, max_score,
    )
    has_both = F.col("_said") & F.col("_text")
    return (
        joined.withColumn("weighted_relevance", F.when(has_both, score).otherwise(0.0))
        .withColumn("is_relevant", F.col("weighted_relevance") >= threshold)
        .drop("_cosine", "_text", "_said", "hashtags_video")
    )
