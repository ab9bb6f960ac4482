import re

from resona.llm import urls

URLS = [
    None, "", "no scheme", "https://Example.ORG", "https://example.org/", "https://a.b.example.org/es/1?x=/en/1", "x://org/",
    "http://notorg.example.net/de/1", "https://www.example.org/en/12#/es/", "HTTPS://A.COM/de/3", "https://a.com/fr/",
    "https://com/fr", "https://www.cheap-pills.example.net/en/1", "https://cheap.pills.net/", "https://cheappills.net/",
    "https://a.net/?u=https://casino-win.com/", "https://spam-farm.example.org/x", "https://a.net/xxx/1", "a://b.net/x\ny?affiliate_id=3",
    "https://free-bets.example.net?x", "https://a.com/free-bets.html", "https://a.net//de/", "https://a.net/xxx/1",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        rule = max(fits, key=lambda r: len(r.text))
        return host, path, rule.text, rule.verdict
    hit = any(re.search(p.regex, (url or "").lower()) for p in urls.PATTERNS)
    return host, path, None, "block" if hit else "allow"


def test_brute_force(spark):
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = urls.judge(frame.withColumnsRenamed({"page_id": "token"})).collect()
    assert {r.token: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute(u) for i, u in enumerate(URLS)}
    assert len(rows) == len(URLS) and urls.judge(frame.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("https://cheap.a.net/1",), ("https://cheap.b.net/2",), ("https://pills.net",)], "_url string")
    from pyspark.sql import functions as F

    tokens = pages.select("_url", F.explode(urls.tokens(F.col("_url"))).alias("token"))
    index = {r.regex: r.token for r in urls.index_patterns(spark, urls.PATTERNS, tokens).collect()}
    assert index[urls.PATTERNS[0].regex] == "pills" and index[r"/(porn|xxx)/"] == "" and len(index) == len(urls.PATTERNS)


def test_tokens_occur_in_what_a_pattern_matches():
    for url in filter(None, URLS):
        for pattern in urls.PATTERNS:
            if re.search(pattern.regex, url.lower()):
                assert set(pattern.tokens) <= set(re.findall("[a-z0-9]+", url.lower()))
