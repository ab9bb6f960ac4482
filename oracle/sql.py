"""The DuckDB statement of every registered query that SQL can express."""

from oracle import clusters as K
from oracle import text as X
from oracle.base import COMMENTS, STAR, VIDEOS, lit, query, values
from resona.functions import patterns as P
from resona.functions import rules as R
from resona.functions import words as W
from resona.functions.guard import BANNED_WORDS
from resona.operators.kpi import CHART_CATEGORIES
from resona.plans.catalogue import DESCRIPTIONS, GIVEN_REFERENCES, GIVEN_TABLES
from resona.plans.metrics import METRICS
from resona.sources.derived import PHRASES, SEQUENCES

# ---- shared pieces -----------------------------------------------------------------------------

FACT = [STAR]
C = [COMMENTS]
V = [VIDEOS]

TYPED = f"""typed AS MATERIALIZED (SELECT * REPLACE (TRY_CAST(publishedat AS TIMESTAMP)::DATE AS publishedat),
  title || ' ' || coalesce(description, '') || ' ' || array_to_string(tags, ' ') AS combined,
  (likecount + commentcount) / (CASE WHEN viewcount = 0 THEN 1 ELSE viewcount END) AS engagement_rate,
  CASE WHEN duration LIKE 'P%' THEN
    coalesce(TRY_CAST(regexp_extract(replace(duration, 'P', ''), '([0-9]+)D', 1) AS DOUBLE), 0) * 86400
    + coalesce(TRY_CAST(regexp_extract(string_split(duration, 'T')[-1], '([0-9]+)H', 1) AS DOUBLE), 0) * 3600
    + coalesce(TRY_CAST(regexp_extract(string_split(duration, 'T')[-1], '([0-9]+)M', 1) AS DOUBLE), 0) * 60
    + coalesce(TRY_CAST(regexp_extract(string_split(duration, 'T')[-1], '([0-9]+)S', 1) AS DOUBLE), 0)
  END AS contentduration_seconds,
  [string_split(u, 'wiki/')[-1] FOR u IN topiccategory IF contains(u, 'wiki/')] AS topics
  FROM videos)"""

VIDEO_TEXT = f"""video_text AS MATERIALIZED (SELECT DISTINCT videoid, {X.clean_basic('combined')} AS video_text,
  {X.hashtags('combined')} AS hashtags_video FROM typed)"""


def embedding(video_source="video_text"):
    return [
        f"vt AS MATERIALIZED (SELECT DISTINCT videoid, video_text FROM {video_source} WHERE trim(video_text) <> '')",
        """vword AS MATERIALIZED (SELECT videoid, w, count(*) AS tf FROM (
             SELECT videoid, unnest(string_split(video_text, ' ')) AS w FROM vt) WHERE length(w) >= 2 GROUP BY ALL)""",
        """widf AS MATERIALIZED (SELECT w, ln((1 + (SELECT count(*) FROM vt)) / (1 + count(*))) + 1 AS idf
             FROM vword GROUP BY w)""",
        """vweight AS MATERIALIZED (SELECT videoid, w, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY videoid)) AS weight
             FROM vword JOIN widf USING (w))""",
    ]


CLEAN_COMMENTS = f"""cc AS MATERIALIZED (SELECT commentid, videoid, {X.clean_basic('commenttext')} AS comment_clean,
  {X.hashtags('commenttext')} AS tags FROM comments)"""
COSINES = [
    """cword AS MATERIALIZED (SELECT commentid, videoid, w, count(*) AS tf FROM (
         SELECT commentid, videoid, unnest(string_split(comment_clean, ' ')) AS w FROM cc) GROUP BY ALL)""",
    """cweight AS MATERIALIZED (SELECT commentid, videoid, w, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY commentid)) AS weight
         FROM cword JOIN widf USING (w))""",
    """cosines AS MATERIALIZED (SELECT commentid, sum(c.weight * v.weight) AS cosine
         FROM cweight c JOIN vweight v USING (videoid, w) GROUP BY commentid)""",
]


def relevances(video_source="video_text"):
    """weighted(commentid, weighted_relevance) for all comments."""
    return [CLEAN_COMMENTS, *embedding(video_source), *COSINES, f"""weighted AS MATERIALIZED (
      SELECT cc.commentid, cc.videoid, CASE WHEN cc.comment_clean = '' OR vt.videoid IS NULL THEN 0.0 ELSE
        least(coalesce(cosine, 0.0) + CASE WHEN list_has_any(cc.tags, v.hashtags_video) THEN 0.1 ELSE 0.0 END, 1.0)
        END::DOUBLE AS weighted_relevance
      FROM cc LEFT JOIN vt USING (videoid) LEFT JOIN cosines USING (commentid)
        LEFT JOIN {video_source} v ON v.videoid = cc.videoid)"""]


TEXT_VIDEOS = [VIDEOS, TYPED, VIDEO_TEXT]

ACTION_CLEAN = f"""action_clean AS MATERIALIZED (SELECT commentid, {X.clean_actionability('commenttext')} AS text_cleaned FROM comments)"""
CATEGORIES = [X.column_of(c) for c in R.WEIGHTS]
ACTION_HITS = "action_hits AS MATERIALIZED (SELECT commentid, text_cleaned, " + ", ".join(
    [f"{X.keyword_hits('text_cleaned', c)} AS {X.column_of(c)}_keywords" for c in R.WEIGHTS]
    + [f"{X.pattern_hits('text_cleaned', c)} AS {X.column_of(c)}_patterns" for c in R.WEIGHTS]
) + " FROM action_clean)"
ACTION_SUMS = "action_sums AS MATERIALIZED (SELECT commentid, text_cleaned, " + ", ".join(
    f"{w} * ({X.column_of(c)}_keywords + {X.column_of(c)}_patterns) AS {X.column_of(c)}" for c, w in R.WEIGHTS.items()
) + " FROM action_hits)"
ACTION = [ACTION_CLEAN, ACTION_HITS, ACTION_SUMS, f"""action AS MATERIALIZED (SELECT commentid, text_cleaned,
  CAST({" + ".join(CATEGORIES)} AS BIGINT) AS actionability_score,
  CASE WHEN greatest({", ".join(CATEGORIES)}) <= 0 THEN 'Not Actionable' """
    + " ".join(f"WHEN {X.column_of(c)} = greatest({', '.join(CATEGORIES)}) THEN {lit(c)}" for c in R.WEIGHTS)
    + " END AS actionability_label FROM action_sums)"]

SENTIMENT = f"""sentiments AS MATERIALIZED (SELECT commentid, CASE WHEN p >= 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment_label,
  greatest(p, 1 - p) AS sentiment_score FROM (SELECT commentid, {X.positive_probability('commenttext')} AS p FROM comments))"""

SPAM = [*X.SPAM_CTES, f"""spam AS MATERIALIZED (SELECT commentid, CASE WHEN first_rule IS NOT NULL THEN 1.0
  ELSE {X.spam_probability('commenttext')} END::DOUBLE AS spam_score FROM spam_first)"""]


def parts(source):
    """prs_parts over a table with scores, likes and labels."""
    return f"""prs_parts AS MATERIALIZED (SELECT *,
      CASE WHEN max(actionability_score) OVER () > 0
        THEN actionability_score / max(actionability_score) OVER () ELSE 0 END::DOUBLE AS actionability_part,
      ((CASE sentiment_label WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END) * sentiment_score + 1) / 2 AS sentiment_part,
      greatest(least(CASE WHEN avg(commentlikes) OVER (PARTITION BY videoid) = 0 THEN 0
        ELSE commentlikes / avg(commentlikes) OVER (PARTITION BY videoid) END / 4, 1), 0)::DOUBLE AS influence_part
      FROM {source}),
    prs AS MATERIALIZED (SELECT *, 0.4::DOUBLE * weighted_relevance + 0.25::DOUBLE * actionability_part
      + 0.2::DOUBLE * sentiment_part + 0.15::DOUBLE * influence_part AS product_resonance_score FROM prs_parts)"""


TOKENS = [f"ct0 AS MATERIALIZED (SELECT commentid, cluster_label, {X.clean_cluster('commenttext')} AS cleaned FROM comments)",
          f"ct1 AS MATERIALIZED (SELECT commentid, cluster_label, {X.short_out(X.slang(X.tokens('cleaned')))} AS tk FROM ct0)",
          f"ct AS MATERIALIZED (SELECT commentid, cluster_label, {X.lemmas(X.meaningless_out(X.stop_out('tk')))} AS tokens FROM ct1)"]


def grams(name, source, tokens="tokens"):
    """name(commentid, term, tf): counts of 1- and 2-grams."""
    return [f"""{name}_w AS (SELECT commentid, [t FOR t IN {tokens} IF length(t) >= 2] AS w FROM {source})""",
            f"""{name} AS MATERIALIZED (SELECT commentid, term, count(*) AS tf FROM (
  SELECT commentid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM {name}_w) GROUP BY ALL)"""]


VOCABULARY = [*grams("gram", "ct"),
    "n_docs AS MATERIALIZED (SELECT count(*) AS n FROM (SELECT commentid FROM gram_w WHERE len(w) > 0))",
    """vocab AS MATERIALIZED (SELECT term, sum(tf) AS cf, count(*) AS df, ln((1 + (SELECT n FROM n_docs)) / (1 + count(*))) + 1 AS idf
      FROM gram GROUP BY term HAVING count(*) <= 0.8::DOUBLE * (SELECT n FROM n_docs) ORDER BY cf DESC, term LIMIT 1000)"""]


def weights(name, gram):
    return f"""{name} AS MATERIALIZED (SELECT commentid, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY commentid)) AS weight
      FROM {gram} JOIN vocab USING (term))"""


TFIDF = [COMMENTS, *TOKENS, *VOCABULARY, weights("tfidf", "gram")]
BOOSTED = f"""boosted AS MATERIALIZED (SELECT term, total / n AS tfidf_score,
  total / n * CASE WHEN term IN ({", ".join(lit(t) for t in W.PRODUCT_TERMS)}) THEN 5 ELSE 1 END AS weighted_score
  FROM (SELECT term, sum(weight) AS total FROM tfidf GROUP BY term),
    (SELECT count(*)::DOUBLE AS n FROM ct WHERE len(tokens) > 0))"""
FILTERED = [*TFIDF, BOOSTED,
            "kept AS MATERIALIZED (SELECT list(term) AS l FROM boosted WHERE weighted_score >= 0.0005::DOUBLE)",
            "ft0 AS MATERIALIZED (SELECT commentid, cluster_label, [t FOR t IN tokens IF list_contains(l, t)] AS tokens FROM ct, kept)",
            "ft AS MATERIALIZED (SELECT *, CASE WHEN len(tokens) = 0 THEN '<empty>' ELSE array_to_string(tokens, ' ') END AS textcleaned FROM ft0)",
            "valid AS MATERIALIZED (SELECT * FROM ft WHERE length(textcleaned) >= 10 AND textcleaned <> '<empty>')"]
SCORED = [*FILTERED, *K.LABELLED, *TEXT_VIDEOS, *relevances(), *SPAM, SENTIMENT, *ACTION, """stages AS MATERIALIZED (
  SELECT c.commentid, c.videoid, c.channelid, c.commentpublishedat, c.commentlikes, c.commenttext, g.cluster_label,
    s.spam_score, s.spam_score >= 0.3 AS is_spam, w.weighted_relevance, w.weighted_relevance >= 0.3 AS is_relevant,
    t.sentiment_label, t.sentiment_score, a.actionability_score, a.actionability_label
  FROM comments c JOIN spam s USING (commentid) JOIN weighted w USING (commentid)
    JOIN sentiments t USING (commentid) JOIN action a USING (commentid) JOIN category_label g USING (commentid))""", parts("stages")]

VECTORS = ["""cells AS MATERIALIZED (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
           "centre AS MATERIALIZED (SELECT label, i, avg(x) AS c FROM cells GROUP BY ALL)"]

DAYS = """days AS (SELECT DISTINCT d FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem
  UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders) WHERE d IS NOT NULL)"""
TAGS = f"tags AS MATERIALIZED (SELECT commentid, videoid, unnest(list_distinct({X.hashtags('commenttext')})) AS hashtag FROM comments)"
EMOJIS = [f"emoji_name(e, name) AS ({values((k, v) for k, v in X.NAMES.items() if 0x1F300 <= ord(k) <= 0x1F6FF)})",
          f"found AS (SELECT commentid, unnest(list_distinct(regexp_extract_all(commenttext, {lit(P.EMOJI)}))) AS e FROM comments)",
          """emojis_of AS MATERIALIZED (SELECT commentid, coalesce(string_agg(coalesce(name, e), '|' ORDER BY coalesce(name, e)), '') AS emojis
            FROM comments LEFT JOIN found USING (commentid) LEFT JOIN emoji_name USING (e) GROUP BY commentid)"""]
TOPICS = "topics AS MATERIALIZED (SELECT videoid, unnest(list_distinct(topics)) AS topiccategory FROM typed)"

ID = "[a-zA-Z0-9_-]{11}"
URLS = """ids AS (SELECT page_id, url, lpad(CAST(page_id AS VARCHAR), 11, 'Ab-_') AS id FROM pages),
urls AS MATERIALIZED (SELECT page_id, unnest([url, 'https://www.example.com/watch?v=' || id || '&t=5', url || '&v=a%20b+c#v=x',
  'https://youtu.be/' || id, 'https://www.example.com/shorts/' || id || ';p=1?x=' || page_id, 'https://www.example.com/embed/' || id,
  'https://www.example.com/shorts/', 'no id', 'https://www.example.com/watch?v=&v=' || id]) AS url FROM ids)"""

DURATIONS = """durations AS (SELECT event_id, CASE event_id % 9
  WHEN 0 THEN 'PT' || event_id % 24 || 'H' || event_id % 60 || 'M' || event_id % 59 || 'S'
  WHEN 1 THEN 'P' || event_id % 9 || 'DT' || event_id % 24 || 'H' WHEN 2 THEN 'P' || event_id % 7 || 'M'
  WHEN 3 THEN 'PT' || event_id || 'S' WHEN 4 THEN '' || event_id WHEN 5 THEN 'P' || event_id % 5 || 'W'
  WHEN 6 THEN 'P' || event_id % 3 || 'DT' WHEN 7 THEN 'PT' || event_id % 50 || 'M' END AS duration FROM events)"""

DATE_TEXTS = """date_texts AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN 'on ' || strftime(ts, '%Y-%m-%d')
  WHEN 4 THEN strftime(ts, '%Y-13-%d') END AS t FROM events)"""

NUMBER_TEXTS = """number_texts AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.9'
  WHEN 2 THEN 'n/a' WHEN 3 THEN '-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 4 THEN '' END AS t FROM events)"""

LOG = """log AS (SELECT event_id, CASE event_id % 12
  WHEN 0 THEN 'SELECT * FROM fact WHERE user_id = ' || user_id WHEN 1 THEN ' select count(*) from fact where likes > ' || event_id
  WHEN 2 THEN 'DROP TABLE t' || event_id WHEN 3 THEN 'SELECT ''update'' FROM t' || event_id
  WHEN 4 THEN 'WITH x AS (SELECT ' || event_id || ') SELECT * FROM x' WHEN 5 THEN 'SELECT 1 UNION ALL SELECT ' || event_id
  WHEN 6 THEN 'SELECT * FROM t WHERE 11 = 10 AND id = ' || event_id WHEN 7 THEN 'SELECT updated FROM t LIMIT ' || event_id
  WHEN 8 THEN 'SELECT 1 UNION SELECT ' || event_id WHEN 9 THEN 'delete from t where id = ' || event_id
  WHEN 10 THEN 'SELECT * FROM t WHERE a = ' || user_id || ' or 1 = 1' ELSE event_type END AS query_text FROM events)"""


def reason(x="upper(trim(query_text))"):
    banned = " ".join(
        f"WHEN regexp_matches({x}, '\\b{w}\\b') THEN 'Dangerous operation detected: \\b{w}\\b'" for w in BANNED_WORDS)
    return (f"CASE {banned} WHEN NOT starts_with({x}, 'SELECT') THEN 'Only SELECT queries are allowed' "
            f"WHEN regexp_matches({x}, 'UNION\\s+ALL|1\\s*=\\s*1|OR\\s+1\\s*=\\s*1') THEN 'Potential SQL injection detected' "
            "ELSE 'Valid SQL query' END")


# ---- metric statements, used alone and in the catalogue ----------------------------------------

TOP_CATEGORY = """SELECT channelid, """ + ", ".join(
    f"coalesce(CAST(sum(likecount_video) FILTER (cluster_label = {lit(c)}) AS BIGINT), 0) AS \"{c}\"" for c in CHART_CATEGORIES
) + """ FROM dim_video JOIN fact USING (videoid)
  WHERE channelid IN (SELECT channelid FROM dim_video GROUP BY channelid ORDER BY sum(likecount_video) DESC, channelid LIMIT 10)
    AND cluster_label IN (""" + ", ".join(lit(c) for c in CHART_CATEGORIES) + ") GROUP BY channelid"

KPI = {
    "kpi_total_videos": "SELECT count(*) AS total_videos FROM dim_video",
    "kpi_avg_engagement": "SELECT coalesce(avg(engagement_rate), 0) AS avg_engagement_rate FROM dim_video",
    "kpi_avg_prs": "SELECT coalesce(avg(product_resonance_score), 0) AS avg_prs FROM fact",
    "kpi_quality_comment_ratio": """SELECT count(*) FILTER (product_resonance_score >= 0.3::DOUBLE) / count(product_resonance_score) AS quality_comment_ratio FROM fact""",
    "engagement_vs_prs": "SELECT engagement_rate, product_resonance_score FROM fact JOIN dim_video USING (videoid)",
    "avg_by_duration": """SELECT contentduration_seconds, avg(engagement_rate) AS avg_engagement, avg(product_resonance_score) AS avg_prs
      FROM fact JOIN dim_video USING (videoid) GROUP BY contentduration_seconds""",
    "top_liked_category": TOP_CATEGORY,
    "topic_distribution": """SELECT topiccategoryid, count(DISTINCT videoid) AS total_videos FROM fact
      GROUP BY topiccategoryid ORDER BY total_videos DESC, topiccategoryid LIMIT 5""",
    "kpi_total_comments": "SELECT count(*) AS total_comments FROM fact",
    "kpi_spam_ratio": "SELECT count(*) FILTER (is_spam) / count(*) AS spam_ratio FROM fact",
    "kpi_comment_quality_pct": "SELECT count(*) FILTER (sentiment_score >= 0.7) / count(*) * 100 AS comment_quality_pct FROM fact",
    "kpi_sentiment_ratio": "SELECT sentiment_label, count(*) / sum(count(*)) OVER () AS share FROM fact WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label",
    "top_hashtags": "SELECT hashtag, count(*) AS count FROM tags GROUP BY hashtag ORDER BY count DESC, hashtag LIMIT 15",
    "avg_prs_by_category": "SELECT cluster_label, avg(product_resonance_score) AS avg_prs FROM fact GROUP BY cluster_label",
    "category_sentiment": "SELECT cluster_label, sentiment_label, count(*) AS count FROM fact WHERE sentiment_label IS NOT NULL GROUP BY ALL",
    "category_trend": "SELECT cluster_label, dateid AS date, count(*) AS total_comments FROM fact GROUP BY ALL",
}
KPI_DOUBLES = {
    "kpi_avg_engagement": ["avg_engagement_rate"], "kpi_avg_prs": ["avg_prs"],
    "kpi_quality_comment_ratio": ["quality_comment_ratio"],
    "engagement_vs_prs": ["engagement_rate", "product_resonance_score"],
    "avg_by_duration": ["avg_engagement", "avg_prs"], "kpi_spam_ratio": ["spam_ratio"],
    "kpi_comment_quality_pct": ["comment_quality_pct"], "kpi_sentiment_ratio": ["share"],
    "avg_prs_by_category": ["avg_prs"],
}


def catalogue():
    """The long table of all metrics, in the order in which they are registered."""
    measures = {
        "kpi_total_videos": ([], ["total_videos"]), "kpi_total_comments": ([], ["total_comments"]),
        "top_liked_category": (["channelid"], CHART_CATEGORIES),
        "topic_distribution": (["topiccategoryid"], ["total_videos"]),
        "top_hashtags": (["hashtag"], ["count"]), "avg_by_duration": (["contentduration_seconds"], ["avg_engagement", "avg_prs"]),
        "kpi_sentiment_ratio": (["sentiment_label"], ["share"]), "avg_prs_by_category": (["cluster_label"], ["avg_prs"]),
        "category_sentiment": (["cluster_label", "sentiment_label"], ["count"]),
        "category_trend": (["cluster_label", "date"], ["total_comments"]),
    }
    selects = []
    for name, (key, statement) in zip(METRICS, KPI.items()):
        keys, numbers = measures.get(key, ([], KPI_DOUBLES.get(key)))
        key_sql = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) or "''"
        for number in numbers:
            selects.append(f"SELECT {lit(name)} AS metric, {key_sql} AS key, {lit(number)} AS measure, "
                           f"CAST(\"{number}\" AS DOUBLE) AS value FROM ({statement})")
    return " UNION ALL ".join(selects)


def given(select, **kw):
    return query(C, select, **kw)


def spark_type():
    return ("CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
            "WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END")


def statements() -> dict[str, str]:
    out = {}
    # Sources and sinks
    lines = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""
    pieces = """pieces AS (SELECT doc_id, i, length(line) AS n, unnest(string_split(line, '. ')) AS piece,
        generate_subscripts(string_split(line, '. '), 1) AS j FROM lines)"""
    out["flatten_threads"] = query([lines, pieces], """SELECT 'p' || doc_id AS videoid,
        'd' || doc_id || '.' || (i - 1) || CASE WHEN j > 1 THEN '.' || (j - 2) ELSE '' END AS commentid, piece AS commenttext,
        CAST(make_date(2024, 1, CAST(doc_id % 28 + 1 AS INTEGER)) AS VARCHAR) AS commentpublishedat,
        CAST(CASE WHEN j = 1 THEN n ELSE j - 2 END AS BIGINT) AS commentlikes FROM pieces""")
    out["video_without_comments"] = query([COMMENTS, VIDEOS], """SELECT v.videoid, v.title, c.commentid, c.commentlikes
        FROM videos v LEFT JOIN comments c USING (videoid)""")
    out["table_scan"] = query(FACT, "SELECT videoid, channelid, likecount_video FROM dim_video")
    out["exact_count"] = query(FACT, "SELECT count(*) AS count FROM fact")
    out["dim_author"] = "SELECT DISTINCT role AS authorid FROM conversations WHERE role IS NOT NULL"
    out["dim_channel"] = query(V, "SELECT DISTINCT channelid FROM videos")
    out["dim_date"] = query([DAYS], """SELECT strftime(d, '%Y%m%d') AS dateid, d AS date, CAST(year(d) AS INTEGER) AS year,
        CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) - 1 AS INTEGER) AS weekday,
        monthname(d) AS monthname, CAST(quarter(d) AS INTEGER) AS quarter FROM days""", dates=["date"])
    out["dim_hashtag"] = query([COMMENTS, TAGS], "SELECT DISTINCT md5(hashtag) AS hashtagid, hashtag FROM tags")
    out["dim_topiccategory"] = query([VIDEOS, TYPED, TOPICS], "SELECT DISTINCT md5(topiccategory) AS topiccategoryid, topiccategory FROM topics")
    out["dim_video"] = query([VIDEOS, TYPED], """SELECT videoid, channelid, strftime(publishedat, '%Y%m%d') AS dateid, viewcount,
        likecount AS likecount_video, commentcount, engagement_rate, contentduration_seconds FROM typed""",
        doubles=["engagement_rate", "contentduration_seconds"])
    out["fact_comments"] = query(SCORED, """SELECT commentid, videoid, CAST(NULL AS VARCHAR) AS authorid, channelid,
        strftime(commentpublishedat, '%Y%m%d') AS dateid, commentlikes AS likecount_comment, is_spam, spam_score, weighted_relevance,
        is_relevant, lower(cluster_label) AS cluster_label, sentiment_label, sentiment_score, actionability_label,
        CAST(actionability_score AS DOUBLE) AS actionability_score, product_resonance_score FROM prs""",
        doubles=["spam_score", "weighted_relevance", "sentiment_score", "actionability_score", "product_resonance_score"],
        flags=["is_spam", "is_relevant"])
    out["bridge_hashtag"] = query([COMMENTS, TAGS], "SELECT DISTINCT md5(hashtag) AS hashtagid, videoid, commentid FROM tags")
    out["bridge_topic_category"] = query([VIDEOS, TYPED, TOPICS], "SELECT DISTINCT md5(topiccategory) AS topiccategoryid, videoid FROM topics")
    out["pk_audit"] = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL"
    refs = [("labels.doc_id", "labels", "doc_id", "documents", "doc_id"), ("embeddings.vec_id", "embeddings", "vec_id", "documents", "doc_id"),
            ("events.event_id", "events", "event_id", "documents", "doc_id"), ("events.user_id", "events", "user_id", "customer", "c_custkey"),
            ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey")]
    out["fk_audit"] = " UNION ALL ".join(
        f"SELECT '{n}' AS constraint_name, CAST({c} AS VARCHAR) AS key, count(*) AS n_rows FROM {t} WHERE {c} IS NOT NULL "
        f"AND {c} NOT IN (SELECT {pc} FROM {p}) GROUP BY {c}" for n, t, c, p, pc in refs)
    out["catalog_describe"] = f"""WITH refers(table_name, column_name, relationship) AS ({values(
        (t, c, f'FOREIGN KEY ({c}) REFERENCES {p}({pc})') for t, c, p, pc in GIVEN_REFERENCES)}),
        about(table_name, description) AS ({values(DESCRIPTIONS.items())}),
        counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in GIVEN_TABLES)})
      SELECT n_rows, c.table_name, CAST(ordinal_position AS INTEGER) AS position, c.column_name, {spark_type()} AS data_type, relationship, description
      FROM information_schema.columns c LEFT JOIN refers r ON r.table_name = c.table_name AND r.column_name = c.column_name
        LEFT JOIN about a ON a.table_name = c.table_name JOIN counts n ON n.table_name = c.table_name
      WHERE c.table_name IN ({", ".join(lit(t) for t in GIVEN_TABLES)})"""
    out["adhoc_sql"] = """SELECT c_custkey, c_name, count(*) AS n_lines, floor(round(sum(l_extendedprice), 10) * 1e6 + 0.5) / 1e6 AS revenue
      FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
      GROUP BY c_custkey, c_name ORDER BY sum(l_extendedprice) DESC, c_custkey LIMIT 10"""
    out["sql_log_audit"] = query([LOG], f"SELECT event_id, query_text, {reason()} = 'Valid SQL query' AS valid, {reason()} AS reason FROM log", flags=["valid"])
    out["preview"] = query(FACT, "SELECT *, (SELECT count(*) FROM dim_video) AS row_count FROM dim_video ORDER BY videoid LIMIT 10", doubles=["engagement_rate"])

    # Projections, predicates, scalar functions
    v_of = "regexp_extract(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '(?:^|&)v=([^&]+)', 1)"
    path = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"
    out["video_id_from_url"] = query([URLS], f"""SELECT page_id, url, CASE WHEN {v_of} <> '' THEN url_decode(replace({v_of}, '+', ' '))
        WHEN contains({path}, 'shorts') THEN regexp_replace(string_split({path}, '/')[-1], ';.*$', '')
        ELSE nullif(regexp_extract(url, '{ID}'), '') END AS video_id FROM urls""")
    out["embed_id_from_url"] = query([URLS], f"""SELECT page_id, url, coalesce(nullif(regexp_extract(url, 'v=({ID})', 1), ''),
        nullif(regexp_extract(url, 'youtu\\.be/({ID})', 1), ''), nullif(regexp_extract(url, 'shorts/({ID})', 1), '')) AS video_id FROM urls""")
    secs = " + ".join(f"coalesce(TRY_CAST(regexp_extract({x}, '([0-9]+){u}', 1) AS DOUBLE), 0) * {m}" for u, m, x in [
        ("D", 86400, "duration"), ("H", 3600, "string_split(duration, 'T')[-1]"), ("M", 60, "string_split(duration, 'T')[-1]"), ("S", 1, "string_split(duration, 'T')[-1]")])
    out["iso_duration_seconds"] = query([DURATIONS], f"SELECT event_id, duration, CASE WHEN starts_with(duration, 'P') THEN {secs} END AS seconds FROM durations", doubles=["seconds"])
    out["topic_from_wiki_url"] = query([VIDEOS, TYPED], """SELECT videoid, array_to_string(topics, '|') AS topics, array_to_string(topics, '|') AS topics_of_text,
        CASE WHEN len(topiccategory) > 0 THEN string_split(topiccategory[1], 'wiki/')[-1] ELSE '' END AS topic_of_first FROM typed""")
    out["coerce_dates"] = query([DATE_TEXTS], "SELECT event_id, t, TRY_CAST(t AS TIMESTAMP)::DATE AS date FROM date_texts", dates=["date"])
    out["coerce_ints"] = query([NUMBER_TEXTS], "SELECT event_id, t, CAST(trunc(coalesce(TRY_CAST(t AS DOUBLE), 0)) AS BIGINT) AS n FROM number_texts")
    out["combined_video_text"] = query([VIDEOS, TYPED], "SELECT videoid, combined FROM typed")
    out["extract_hashtags"] = given(f"SELECT commentid, array_to_string({X.hashtags('commenttext')}, '|') AS hashtags FROM comments")
    out["extract_emojis"] = query([COMMENTS, *EMOJIS], "SELECT commentid, emojis FROM emojis_of")
    out["clean_text_basic"] = given(f"SELECT commentid, {X.clean_basic('commenttext')} AS cleaned FROM comments")
    out["clean_text_sentiment"] = given(f"SELECT commentid, {X.clean_sentiment('commenttext')} AS cleaned FROM comments")
    out["clean_text_actionability"] = query([COMMENTS, ACTION_CLEAN], "SELECT commentid, text_cleaned AS cleaned FROM action_clean")
    out["demojize"] = given(f"SELECT commentid, {X.demojize('commenttext')} AS spelled FROM comments")
    out["remove_stopwords"] = f"SELECT doc_id, array_to_string({X.stop_out(X.words_of('lower(text)'), W.ENGLISH_STOP_WORDS)}, ' ') AS kept FROM documents"
    out["engagement_rate"] = query([VIDEOS, TYPED], "SELECT videoid, engagement_rate FROM typed", doubles=["engagement_rate"])
    out["clean_text_cluster"] = given(f"SELECT commentid, {X.clean_cluster('commenttext')} AS cleaned FROM comments")
    out["tokenize_reduce"] = given(f"SELECT commentid, array_to_string({X.tokens(X.clean_cluster('commenttext'))}, ' ') AS tokens FROM comments")
    out["expand_slang"] = given(f"SELECT commentid, array_to_string({X.slang(X.words_of('lower(commenttext)'))}, ' ') AS tokens FROM comments")
    out["token_filters"] = given(f"""SELECT commentid, array_to_string([t FOR t IN {X.short_out(X.words_of('lower(commenttext)'))}
        IF NOT regexp_full_match(t, '\\p{{N}}+') AND regexp_matches(t, {lit(P.WORD)}) AND (length(t) > 1 OR t = 'i' OR t = 'a')], ' ') AS tokens FROM comments""")
    out["lemmatize"] = given(f"SELECT commentid, array_to_string({X.lemmas(X.words_of('lower(commenttext)'))}, ' ') AS tokens FROM comments")
    out["too_short_flag"] = query([COMMENTS, *TOKENS], "SELECT commentid, length(array_to_string(tokens, ' ')) < 10 AS too_short FROM ct", flags=["too_short"])
    out["boost_terms"] = query([*TFIDF, BOOSTED], "SELECT term, tfidf_score, weighted_score FROM boosted", doubles=["tfidf_score", "weighted_score"])

    # Spam
    out["spam_rule_flags"] = query([COMMENTS, *X.SPAM_CTES], "SELECT * EXCLUDE (commenttext) FROM spam_first", flags=[f"rule_{r}" for r in "abcdefghij"])
    out["spam_model_score"] = given(f"SELECT commentid, {X.spam_probability('commenttext')} AS spam_score FROM comments", doubles=["spam_score"])
    out["spam_final"] = query([COMMENTS, *SPAM], "SELECT commentid, spam_score, spam_score >= 0.3 AS is_spam FROM spam", doubles=["spam_score"], flags=["is_spam"])

    # Relevance
    both = [COMMENTS, *TEXT_VIDEOS]
    out["distinct_video_texts"] = query([*TEXT_VIDEOS, embedding()[0]], "SELECT * FROM vt")
    out["text_embedding"] = query([*TEXT_VIDEOS, *embedding()], "SELECT videoid, w AS term, weight FROM vweight", doubles=["weight"])
    out["rowwise_cosine"] = query([*both, CLEAN_COMMENTS, *embedding(), *COSINES], """SELECT commentid,
        CASE WHEN vt.videoid IS NOT NULL THEN coalesce(cosine, 0.0) END::DOUBLE AS cosine FROM cc LEFT JOIN vt USING (videoid) LEFT JOIN cosines USING (commentid)""", doubles=["cosine"])
    out["hashtag_overlap_bonus"] = query([*both, CLEAN_COMMENTS], """SELECT commentid, CASE WHEN list_has_any(tags, hashtags_video) THEN 0.1 ELSE 0.0 END::DOUBLE AS bonus
        FROM cc JOIN video_text USING (videoid)""", doubles=["bonus"])
    out["weighted_relevance"] = query([*both, *relevances()], "SELECT commentid, weighted_relevance FROM weighted", doubles=["weighted_relevance"])
    out["is_relevant"] = query([*both, *relevances()], "SELECT videoid, count(*) FILTER (weighted_relevance >= 0.3) AS relevant, count(*) AS comments FROM weighted GROUP BY videoid")
    blanked = f"""video_text2 AS MATERIALIZED (SELECT videoid, CASE WHEN viewcount = 0 THEN '' ELSE {X.clean_basic('combined')} END AS video_text,
        CASE WHEN viewcount = 0 THEN [] ELSE {X.hashtags('combined')} END AS hashtags_video FROM typed)"""
    out["relevance_routing"] = query([COMMENTS, VIDEOS, TYPED, blanked, *relevances("video_text2")],
        "SELECT commentid, weighted_relevance, weighted_relevance >= 0.3 AS is_relevant FROM weighted", doubles=["weighted_relevance"], flags=["is_relevant"])

    # Sentiment and actionability
    out["sentiment"] = query([COMMENTS, SENTIMENT], "SELECT * FROM sentiments", doubles=["sentiment_score"])
    kw = ", ".join(f"{c}_keywords" for c in CATEGORIES)
    pt = ", ".join(f"{c}_patterns" for c in CATEGORIES)
    out["rule_keyword_hits"] = query([COMMENTS, ACTION_CLEAN, ACTION_HITS], f"SELECT commentid, {kw} FROM action_hits")
    out["rule_regex_hits"] = query([COMMENTS, ACTION_CLEAN, ACTION_HITS], f"SELECT commentid, {pt} FROM action_hits")
    out["actionability_score"] = query([COMMENTS, *ACTION], "SELECT commentid, actionability_score FROM action")
    out["actionability_label"] = query([COMMENTS, *ACTION], "SELECT commentid, actionability_label FROM action")
    out["actionability"] = query([COMMENTS, *ACTION], "SELECT * FROM action")

    # Clustering
    out["cluster_preprocess"] = query([COMMENTS, *TOKENS], "SELECT commentid, array_to_string(tokens, ' ') AS textcleaned FROM ct")
    out["tfidf_1_2grams"] = query(TFIDF, "SELECT * FROM tfidf", doubles=["weight"])
    out["corpus_term_scores"] = query([*TFIDF, BOOSTED], "SELECT * FROM boosted WHERE weighted_score >= 0.0005::DOUBLE", doubles=["tfidf_score", "weighted_score"])
    out["vocab_filter"] = query(FILTERED, "SELECT commentid, textcleaned FROM ft")
    out["valid_row_mask"] = query(FILTERED, "SELECT commentid, textcleaned FROM valid")
    out["kmeans_assign"] = query([*VECTORS, "d AS (SELECT vec_id, c.label AS cluster, round(sum((x - c.c) ** 2), 9) AS d FROM cells JOIN centre c USING (i) GROUP BY ALL)"],
        "SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY vec_id")
    out["silhouette"] = query([*VECTORS, "size AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)",
        "sq AS (SELECT vec_id, label, sum(x * x) AS s FROM cells GROUP BY ALL)", "spread AS (SELECT label, avg(s) AS m FROM sq GROUP BY label)",
        "mean_d AS (SELECT q.vec_id, q.label, c.label AS other, any_value(q.s) + any_value(p.m) - 2 * sum(x * c.c) AS d FROM cells JOIN centre c USING (i) JOIN sq q USING (vec_id) JOIN spread p ON p.label = c.label GROUP BY ALL)",
        """ab AS (SELECT vec_id, any_value(n) AS n, any_value(d * n / (n - 1)) FILTER (m.label = other) AS a, min(d) FILTER (m.label <> other) AS b
            FROM mean_d m JOIN size s ON s.label = m.label GROUP BY vec_id)"""],
        "SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab", doubles=["silhouette"])
    out["invalid_to_other"] = query(FILTERED, "SELECT commentid, CASE WHEN v.commentid IS NULL THEN 'others' ELSE ft.cluster_label END AS label FROM ft LEFT JOIN valid v USING (commentid)")
    out["cluster_sizes"] = query(FILTERED, "SELECT cluster_label, count(*) AS size FROM valid GROUP BY cluster_label")
    top_terms = [*grams("fgram", "ft"), weights("fw", "fgram"), """ranked AS (SELECT cluster_label, term, score,
        row_number() OVER (PARTITION BY cluster_label ORDER BY round(score, 9) DESC, term) AS rank FROM (
          SELECT cluster_label, term, sum(weight) / any_value(n) AS score FROM fw JOIN valid USING (commentid)
            JOIN (SELECT cluster_label, count(*) AS n FROM valid GROUP BY cluster_label) USING (cluster_label) GROUP BY cluster_label, term) WHERE score > 0)"""]
    out["cluster_top_terms"] = query([*FILTERED, *top_terms],
        "SELECT cluster_label, CAST(rank AS INTEGER) AS rank, term, score FROM ranked WHERE rank <= 10", doubles=["score"])
    out["cluster_profile"] = query([*FILTERED, *top_terms, *K.TEXTS, *K.GIVEN, *K.CATEGORY,
        "terms_of AS (SELECT cluster_label, string_agg(term, '|' ORDER BY rank) AS top_terms FROM ranked WHERE rank <= 10 GROUP BY cluster_label)",
        """near_of AS (SELECT cluster AS cluster_label, string_agg(commentid, '|' ORDER BY rank) AS representatives,
          string_agg(textcleaned, '|' ORDER BY rank) AS samples FROM chosen JOIN dt USING (p) GROUP BY cluster)"""],
        """SELECT cluster_label, size, top_terms, representatives, samples FROM (SELECT cluster_label, count(*) AS size FROM valid GROUP BY cluster_label)
           LEFT JOIN terms_of USING (cluster_label) LEFT JOIN near_of USING (cluster_label)""")
    out["cluster_representatives"] = query([*VECTORS, """ranked AS (SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS rank
        FROM (SELECT label, vec_id, sqrt(sum((x - c) ** 2)) AS distance FROM cells JOIN centre USING (label, i) GROUP BY ALL))"""],
        "SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, distance FROM ranked WHERE rank <= 3", doubles=["distance"])
    given_labels = [*FILTERED, *K.TEXTS, *K.GIVEN, *K.CATEGORY]
    out["label_cluster"] = query(given_labels, "SELECT cluster AS cluster_label, category FROM category_of")
    out["apply_cluster_label"] = query(given_labels, "SELECT commentid, coalesce(category, 'others') AS cluster_label FROM ft LEFT JOIN clustered USING (commentid) LEFT JOIN category_of USING (cluster)")
    out["kmeans"] = query([*FILTERED, *K.TEXTS, *K.fitted([3])], "SELECT textcleaned, w AS weight, CAST(j AS INTEGER) AS cluster FROM dt JOIN own USING (p)", doubles=["weight"])
    out["kmeans_of_vectors"] = query([*K.VECTORS, *K.fitted([3])], "SELECT p AS vec_id, CAST(j AS INTEGER) AS cluster FROM own")
    out["relevance_of_vectors"] = query([], """SELECT a.vec_id AS commentid, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine,
        least(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + CASE WHEN a.label = b.label THEN 0.1 ELSE 0.0 END, 1.0) AS weighted_relevance
        FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id % 50""", doubles=["cosine", "weighted_relevance"])
    out["lemmatize_by_table"] = query(["w AS (SELECT doc_id, [t FOR t IN string_split_regex(lower(text), '[^a-z]+') IF t <> ''] AS t FROM documents)"],
        """SELECT doc_id, array_to_string([CASE WHEN regexp_full_match(x, '[a-z]{2,}ed') THEN x[:-3] WHEN regexp_full_match(x, '[a-z]{3,}s') THEN x[:-2]
           ELSE x END FOR x IN t], ' ') AS tokens FROM w""")
    spelled = f"{X.pick_of(PHRASES, 'event_id')} || ' ' || {X.pick_of(SEQUENCES, 'event_id')}"
    names = {"👩🏿‍💻": "woman_technologist_dark_skin_tone", "👩‍💻": "woman_technologist", "💇‍♀️": "woman_getting_haircut",
             "👍🏽": "thumbs_up_medium_skin_tone", "🇫🇷": "flag_fr", "🇩🇪": "flag_de", "1️⃣": "keycap_1", "❤️": "red_heart", "👍": "thumbs_up",
             "😍": "smiling_face_with_heart-eyes", "💇": "person_getting_haircut", "😂": X.NAMES["😂"]}
    for sequence, name in names.items():
        spelled = f"replace({spelled}, {lit(sequence)}, {lit(f':{name}:')})"
    out["demojize_sequences"] = f"SELECT 'c' || event_id AS commentid, {spelled} AS spelled FROM events"
    out["choose_k"] = query([*FILTERED, *K.TEXTS, *K.CHOICE], "SELECT CAST(s.k AS INTEGER) AS k, score, s.k = pick.k AS chosen FROM scores s, pick", doubles=["score"], flags=["chosen"])
    out["product_clusters"] = query([*FILTERED, *K.LABELLED], "SELECT commentid, cluster_label FROM category_label")

    # Resonance score
    given_parts = [COMMENTS, parts("comments")]
    for name, column in [("prs_actionability", "actionability_part"), ("prs_sentiment", "sentiment_part"), ("prs_influence", "influence_part")]:
        out[name] = query(given_parts, f"SELECT commentid, {column} FROM prs", doubles=[column])
    out["prs"] = query(given_parts, "SELECT commentid, product_resonance_score FROM prs", doubles=["product_resonance_score"])
    out["score_comments"] = query(SCORED, """SELECT commentid, spam_score, is_spam, weighted_relevance, is_relevant, sentiment_label, sentiment_score,
        actionability_score, actionability_label, cluster_label, product_resonance_score FROM prs""",
        doubles=["spam_score", "weighted_relevance", "sentiment_score", "product_resonance_score"], flags=["is_spam", "is_relevant"])

    # Dashboard metrics
    for name, statement in KPI.items():
        ctes = [COMMENTS, TAGS] if name == "top_hashtags" else FACT
        out[name] = query(ctes, statement, doubles=KPI_DOUBLES.get(name, ()), dates=["date"] if name == "category_trend" else ())
    out["metric_catalogue"] = query([STAR, COMMENTS, TAGS], catalogue(), doubles=["value"])

    # Report and pages
    out["report_counts"] = query(FACT, """SELECT count(*) AS total_comments, count(*) FILTER (is_spam) AS spam_count, count(*) FILTER (NOT is_spam) AS valid_comments,
        count(*) FILTER (is_spam) / count(*) * 100 AS spam_ratio, avg(weighted_relevance) AS avg_relevance, avg(product_resonance_score) AS avg_product_resonance FROM fact""",
        doubles=["spam_ratio", "avg_relevance", "avg_product_resonance"])
    out["report_sentiment_dist"] = query(FACT, """SELECT videoid, sentiment_label, count(*) / sum(count(*)) OVER (PARTITION BY videoid) AS share FROM fact
        WHERE sentiment_label IS NOT NULL GROUP BY videoid, sentiment_label""", doubles=["share"])
    out["relevance_buckets"] = query(FACT, """SELECT count(*) FILTER (weighted_relevance > 0.7) AS high, count(*) FILTER (weighted_relevance >= 0.3 AND weighted_relevance <= 0.7) AS medium,
        count(*) FILTER (weighted_relevance < 0.3) AS low FROM fact""")
    out["category_distribution"] = query(FACT, "SELECT cluster_label, count(*) / sum(count(*)) OVER () AS share FROM fact GROUP BY cluster_label", doubles=["share"])
    out["top3_categories"] = query(FACT, "SELECT cluster_label, count(*) AS count FROM fact GROUP BY cluster_label ORDER BY count DESC, cluster_label LIMIT 3")

    def bins(value, n, by=""):
        edge = f"edge AS (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM fact)"
        counted = f"""counted AS (SELECT {by} CAST(least(floor(({value} - lo) / (hi - lo) * {n}), {n - 1}) AS INTEGER) AS bin, count(*) AS count
            FROM fact, edge WHERE {value} IS NOT NULL GROUP BY ALL)"""
        return [STAR, edge, counted]

    def edges(n):
        return f"lo + (hi - lo) / {n} * bin AS bin_start, lo + (hi - lo) / {n} * (bin + 1) AS bin_end"

    out["relevance_histogram"] = query(bins("weighted_relevance", 10), f"""SELECT b.bin, lo + (hi - lo) / 10 * b.bin AS bin_start, lo + (hi - lo) / 10 * (b.bin + 1) AS bin_end,
        coalesce(count, 0) AS count FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b LEFT JOIN counted USING (bin), edge""", doubles=["bin_start", "bin_end"])
    out["prs_histogram_by_category"] = query(bins("product_resonance_score", 20, "cluster_label,"), f"SELECT cluster_label, bin, {edges(20)}, count FROM counted, edge", doubles=["bin_start", "bin_end"])
    report = """report AS (SELECT doc_id, 'EXECUTIVE SUMMARY' || chr(10) || text || chr(10) || 'Audience insights:' || chr(10) || lang || chr(10) || '  ' || source
        || chr(10) || 'PRODUCT ANALYSIS' || chr(10) || text || chr(10) || 'these contents are lost' || chr(10) || lang || chr(10) || 'Actionable steps' || chr(10) || n_chars AS text FROM documents)"""
    numbered = f"""numbered AS (SELECT doc_id, {X.strip('line')} AS line, i FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM report))"""
    coded = """coded AS (SELECT *, CASE WHEN contains(upper(line), 'EXECUTIVE SUMMARY') THEN 0 WHEN contains(upper(line), 'AUDIENCE') THEN 1
        WHEN contains(upper(line), 'PRODUCT') THEN 2 WHEN contains(upper(line), 'CONTENT') THEN 3
        WHEN contains(upper(line), 'RECOMMENDATIONS') OR contains(upper(line), 'ACTIONABLE') THEN 4 END AS code FROM numbered WHERE line <> '')"""
    placed = """placed AS (SELECT *, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS section FROM coded)"""
    out["sectionize"] = query([report, numbered, coded, placed], "SELECT doc_id, " + ", ".join(
        f"coalesce(string_agg(line, ' ' ORDER BY i) FILTER (code IS NULL AND section = {i}), '') AS {n}"
        for i, n in enumerate(["executive_summary", "audience_insights", "product_analysis", "content_performance", "recommendations"])) + " FROM placed GROUP BY doc_id")
    out["page_metrics"] = query(FACT, """SELECT count(*) AS total_comments,
        printf('%.0f', count(*) FILTER (NOT is_spam) / count(*) * 100) || ' : ' || printf('%.0f', count(*) FILTER (is_spam) / count(*) * 100) AS nonspam_spam_ratio,
        round_even(count(*) FILTER (is_relevant) / count(*) * 100, 2) AS relevance_pct, round_even(avg(product_resonance_score), 2) AS avg_prs FROM fact""",
        doubles=["relevance_pct", "avg_prs"])
    out["sentiment_share_by_category"] = query(FACT, """SELECT cluster_label, count(*) FILTER (sentiment_label = 'POSITIVE') / count(*) AS positive,
        count(*) FILTER (sentiment_label = 'NEGATIVE') / count(*) AS negative FROM fact WHERE sentiment_label IS NOT NULL GROUP BY cluster_label""", doubles=["positive", "negative"])
    out["actionability_distribution"] = query([COMMENTS, *ACTION], "SELECT actionability_label, count(*) AS count FROM action GROUP BY actionability_label")
    out["relevance_sentiment_points"] = query(FACT, "SELECT weighted_relevance, sentiment_score, cluster_label FROM fact", doubles=["weighted_relevance", "sentiment_score"])
    table = "commentid, commentpublishedat, commentlikes, commenttext, hashtags_comments, emojis_comments, spam_score, is_spam, weighted_relevance, is_relevant, sentiment_label, sentiment_score, actionability_score, actionability_label, cluster_label, product_resonance_score"
    shown = dict(doubles=["spam_score", "weighted_relevance", "sentiment_score", "product_resonance_score"],
                 dates=["commentpublishedat"], flags=["is_spam", "is_relevant"])
    marked = [*SCORED, *EMOJIS, f"marked AS (SELECT s.*, array_to_string({X.hashtags('s.commenttext')}, '|') AS hashtags_comments, emojis AS emojis_comments FROM prs s JOIN emojis_of USING (commentid))"]
    out["comment_table"] = query(marked, f"SELECT {table} FROM marked", **shown)
    out["write_scored"] = query(marked, f"SELECT {table}, videoid, channelid FROM marked", **shown)
    return out
