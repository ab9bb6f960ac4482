"""Common table expressions: the derived views of the queries, as DuckDB SQL."""

from resona.sources.derived import CATEGORIES, PHRASES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(x):
        return lit(x) if isinstance(x, str) else "NULL" if x is None else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


def pick(items, index: str) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(items)) + " END)"


COMMENTS = f"""comments AS MATERIALIZED (
  SELECT 'c' || e.event_id AS commentid, 'v' || e.user_id AS videoid,
    'ch' || (e.user_id % 12) AS channelid, CAST(e.ts AS DATE) AS commentpublishedat,
    CAST(floor(e.value) AS BIGINT) AS commentlikes,
    {pick(PHRASES, f"e.event_id % {len(PHRASES)}")}
      || CASE WHEN e.event_id % 5 = 0 THEN ' #' || e.event_type ELSE '' END
      || coalesce(' ' || d.text, '') AS commenttext,
    {pick(CATEGORIES, "e.event_id % 6")} AS cluster_label,
    CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'POSITIVE'
         WHEN e.event_type = 'error' THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label,
    (50 + (e.event_id * 37) % 50) / 100.0::DOUBLE AS sentiment_score,
    least(((e.event_id * 53) % 140 - 20) / 100.0::DOUBLE, 1.0::DOUBLE) AS weighted_relevance,
    (e.event_id * 7) % 23 AS actionability_score
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id)"""

WIKI = "https://en.wikipedia.org/wiki/"
VIDEOS = f"""per_user AS (
  SELECT user_id AS u, min(ts) AS first_ts, CAST(sum(floor(value)) AS BIGINT) AS points,
    count(*) FILTER (event_type = 'click') AS clicks, count(*) AS n
  FROM events GROUP BY user_id),
videos AS MATERIALIZED (
  SELECT 'v' || u AS videoid,
    'Video ' || u || ' ' || {pick(["makeup tutorial", "skin care routine", "hair repair tips"], "u % 3")} AS title,
    b.text || ' #' || {pick(["makeup", "skincare", "beauty"], "u % 3")}
      || CASE WHEN u % 4 = 0 THEN ' https://shop.example.com/a 😍' ELSE '' END AS description,
    strftime(first_ts, '%Y-%m-%dT%H:%M:%SZ') AS publishedat, 'ch' || (u % 12) AS channelid,
    CASE WHEN u % 5 = 0 THEN CAST([] AS VARCHAR[])
         ELSE ['review', {pick(["makeup", "skincare", "hair"], "u % 3")}] END AS tags,
    CASE u % 6 WHEN 0 THEN 'PT' || (u % 12) || 'M' || ((u * 7) % 60) || 'S'
      WHEN 1 THEN 'PT1H' || (u % 60) || 'M' WHEN 2 THEN 'P1DT2H' WHEN 3 THEN 'P1M'
      WHEN 4 THEN 'bad' ELSE 'PT' || u || 'S' END AS duration,
    CASE WHEN u % 10 = 0 THEN 0 ELSE points * 10 END AS viewcount, clicks AS likecount,
    n AS commentcount,
    CASE WHEN u % 7 = 0 THEN CAST([] AS VARCHAR[])
      ELSE ['{WIKI}' || {pick(["Lifestyle", "Fashion", "Health"], "u % 3")}, '{WIKI}Beauty',
            'https://example.org/other'] END AS topiccategory
  FROM per_user LEFT JOIN benchmark b ON b.item_id = u % (SELECT count(*) FROM benchmark)
  UNION ALL
  SELECT 'v_none', 'Quiet video', NULL, 'not a date', 'ch0', CAST([] AS VARCHAR[]), 'PT5S', 10, 0, 0,
    CAST([] AS VARCHAR[]))"""

STAR = """dim_video AS (
  SELECT o_orderkey AS videoid, o_custkey AS channelid,
    CAST(floor(o_totalprice) AS BIGINT) AS likecount_video, o_totalprice / 500000.0 AS engagement_rate,
    (o_orderkey * 13) % 600 AS contentduration_seconds
  FROM orders),
fact AS MATERIALIZED (
  SELECT l_orderkey AS videoid, l_orderkey || '-' || l_linenumber AS commentid,
    CAST(l_shipdate AS DATE) AS dateid,
    CASE p_type WHEN 'MEDIUM' THEN 'make up' WHEN 'STANDARD' THEN 'skin care'
      WHEN 'PROMO' THEN 'hair treatment' WHEN 'ECONOMY' THEN 'cosmetics (eye & lip)'
      WHEN 'SMALL' THEN 'physical appearance' ELSE 'others' END AS cluster_label,
    CASE WHEN l_returnflag = 'A' THEN 'POSITIVE' WHEN l_returnflag = 'R' THEN 'NEGATIVE'
      WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'NEUTRAL' END AS sentiment_label,
    l_quantity / 50 AS sentiment_score, l_quantity / 50 AS weighted_relevance,
    CASE WHEN l_tax > 0 THEN l_discount * 10 + 0.0 END AS product_resonance_score,
    l_linestatus = 'F' AS is_spam, l_quantity / 50 >= 0.3 AS is_relevant, p_brand AS topiccategoryid
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def query(ctes, select: str, doubles=(), dates=(), flags=()) -> str:
    """The select over the CTEs; numbers rounded to six places, dates as text, flags as 0/1."""
    replaced = [f"floor(round({c}, 10) * 1e6 + 0.5) / 1e6 AS {c}" for c in doubles]
    replaced += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
    replaced += [f"CAST({c} AS INTEGER) AS {c}" for c in flags]
    replace = f" REPLACE ({', '.join(replaced)})" if replaced else ""
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT *{replace} FROM ({select})"
