"""URL filter: pattern rules indexed by their rarest literal token, and host rules that come first.

A pattern is a regular expression over the lower-cased URL. Each one names literal tokens, runs of
letters and digits that every URL it matches has between other characters. The rule is filed under the
one of them that the fewest URLs have; a URL's tokens fetch the rules filed under them, and only those
run their expression. Rules without a literal token are fetched by every URL.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import col, read, scratch
from resona.session import cut_lineage

MAX_RULES_BROADCAST = 50_000  # rows of the rule index sent to all tasks; a longer one is joined


@dataclass(frozen=True)
class HostRule:
    """Allow or block a host, its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """Block URLs that match `regex`; `tokens` are literal tokens of every such URL."""

    regex: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("allow", "org"), HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"), HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

PATTERNS = tuple(
    Pattern(rf"://([^/?#]*[.-])?{a}[.-]{b}[.-][^/?#]*", (a, b))
    for a, b in (
        ("cheap", "pills"), ("casino", "win"), ("spam", "farm"), ("ads", "track"), ("adult", "x"),
        ("free", "bets"), ("online", "casino"), ("payday", "loans"), ("click", "bait"), ("link", "farm"),
    )
) + (
    Pattern(r"/(porn|xxx)/", ()),
    Pattern(r"[?&]affiliate_id=\d+", ("affiliate", "id")),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: host from the first :// to /, ?, # or the end, A-Z in lower case; path from there to
    ?, # or the end. Both empty for null and for a URL without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null; of equally long ones block, then the
    first by text."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    text = verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """The distinct runs of a-z and 0-9 of a lower-cased URL, and an empty one for rules without tokens."""
    return F.array_union(
        F.array(F.lit("")), F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def index_patterns(spark: SparkSession, patterns: Sequence[Pattern], url_tokens: DataFrame) -> DataFrame:
    """(token, regex): each pattern under its rarest token, counted over the distinct URLs in
    `url_tokens` (url, token); of equally rare ones the first by name."""
    rules = spark.createDataFrame(
        [(p.regex, t) for p in patterns for t in p.tokens or ("",)], "regex string, token string")
    wanted = rules.select("token").distinct()
    wanted = F.broadcast(wanted) if len(patterns) <= MAX_RULES_BROADCAST else wanted
    counts = url_tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    return rules.join(counts, "token", "left").groupBy("regex").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def judge(
    pages: DataFrame, url: str = "url", host_rules: Sequence[HostRule] = HOST_RULES,
    patterns: Sequence[Pattern] = PATTERNS,
) -> DataFrame:
    """`pages` with the added columns host, path, rule and verdict; columns of these names are replaced.

    The verdict is that of the longest fitting host rule; without one, `block` if a pattern matches and
    `allow` otherwise, so null and empty URLs are allowed. Patterns run once per distinct URL, however long. Rows come
    back one for one, repeated ones too; an empty table gives an empty result; other columns stay, whatever their names.
    """
    spark, given = pages.sparkSession, col(url)
    host, path = parts(given)
    rule, verdict = host_rule(host, path, host_rules)
    ours = {"host": host, "path": path, "rule": rule, "verdict": verdict}
    key, hit, *kept = scratch(pages, "url", "hit", *ours)
    ruled = pages.withColumns(dict(zip(kept, (host, path)))).withColumns(dict(zip(kept[2:], (rule, verdict))))
    urls = cut_lineage(pages.select(given.alias("url")).filter("url is not null").distinct())
    url_tokens = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    index = cut_lineage(index_patterns(spark, patterns, url_tokens))
    index = F.broadcast(index) if len(patterns) <= MAX_RULES_BROADCAST else index
    hits = (
        url_tokens.join(index, "token").filter(F.rlike(F.lower("url"), F.col("regex")))
        .select(F.col("url").alias(key)).distinct().withColumn(hit, F.lit("block"))
    )
    names = [c for c in pages.columns if c.lower() not in ours]
    joined = ruled.join(cut_lineage(hits), given == col(key), "left")
    judged = F.coalesce(col(kept[3]), col(hit), F.lit("allow")).alias("verdict")
    return joined.select(*map(col, names), *[col(k).alias(n) for k, n in zip(kept[:3], ours)], judged)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    order = sorted(HOST_RULES, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    cases = [
        (f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)}))"
         f" AND starts_with(path, {quoted(r.path)})", r) for r in order
    ]
    rule = " ".join(f"WHEN {c} THEN {quoted(r.text)}" for c, r in cases)
    verdict = " ".join(f"WHEN {c} THEN {quoted(r.verdict)}" for c, r in cases)
    hit = " OR ".join(f"regexp_matches(lower(url), {quoted(p.regex)})" for p in PATTERNS)
    return f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN url IS NOT NULL AND ({hit}) THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


SQL = _sql()
