import hashlib
import random
import re

from resona.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    """(n_words, n_hit, items, contaminated) of a text."""
    def words(t):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, found = words(text), set(), set()
    for item, source in items:
        tokens = words(source)
        size = min(13, len(tokens))
        for i in range(len(tokens) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j:j + size] == tokens[i:i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def cases():
    rng = random.Random(7)
    words = ["the", "of", "a1", "Été", "漢字", "x", "And", "zeta"]
    long = [" ".join(rng.choices(words, k=40)) for _ in range(4)]
    items = [(i, t) for i, t in enumerate(long)] + [(10, "short item"), (11, None), (12, ""), (13, "..."), (14, long[0]), (2, "one")]
    texts = [None, "", "-- !!", "Short, ITEM.", "one", "nothing here"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(10)]
    texts += [f"pre fix {t.upper() if i else t}, post" for i, t in enumerate(long)]
    texts += [("pad " * 900) + long[1][5:90], "the " * 3000, " ".join(long[2].split()[:12])]
    return texts, items


def test_brute_force(spark, docs):
    texts, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = {i: brute(t, items) for i, t in enumerate(texts)}
    for block in (10**7, 3):
        matches = d.occurrences(docs(*enumerate(texts)).repartition(3), benchmark, block_phrases=block)
        rows = d.judged(matches).collect()
        found = {r.doc_id: (r.n_words, r.n_hit, r.items_, r.contaminated) for r in (
            type("R", (), {**r.asDict(), "items_": sorted(set(r["items"]))}) for r in rows)}
        assert found == expected and len(rows) == len(texts)


def test_no_benchmark_text_passes_through_the_driver(spark, docs, monkeypatch):
    texts, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def refused(*_, **__):
        raise AssertionError("rows sent to the driver")

    with monkeypatch.context() as patch:
        for name in ("toLocalIterator", "collect", "toPandas"):
            patch.setattr(type(benchmark), name, refused)
        matches = d.occurrences(docs(*enumerate(texts)), benchmark, block_phrases=5)
    found = {r.doc_id: r.n_hit for r in d.judged(matches).collect()}
    assert found == {i: brute(t, items)[1] for i, t in enumerate(texts)}


def test_null_ids_repeated_rows_and_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    frame = docs((None, "short item"), (2**60 + 1, "short item"), (2**60 + 1, "short item"), (3, "clean"))
    for block in (10**7, 1):
        more = benchmark.union(benchmark.selectExpr("item_id + 1", "'other thing'"))
        found = sorted((r.doc_id or 0, r.n_hit) for r in d.judged(d.occurrences(frame, more, block_phrases=block)).collect())
        assert found == [(0, 2), (3, 0), (2**60 + 1, 2), (2**60 + 1, 2)]
    assert [r.doc_id for r in d.without_contaminated(frame, benchmark).collect()] == [3]
    assert d.without_contaminated(frame, benchmark.limit(0)).count() == 4
    assert d.decontaminate(frame.limit(0), benchmark).collect() == []


def test_phrases_go_to_the_shards_of_their_rarest_term(spark, docs, monkeypatch):
    """Many shards: each is searched for its own phrases only, without a cross join, and no match is missed."""
    monkeypatch.setattr(d, "SHARD_WORDS", 50)
    items = [(i, " ".join(f"w{i}x{j}" if j % 4 else "the" for j in range(20))) for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"the the {items[i % 30][1]} and more of the same" if i % 3 else "the clean text of the " * 5 for i in range(60)]
    matches = d.occurrences(docs(*enumerate(texts)), benchmark)
    assert "CartesianProduct" not in matches._jdf.queryExecution().toString()
    assert "NestedLoop" not in matches._jdf.queryExecution().toString()
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.judged(matches).collect()}
    assert found == {i: brute(t, items) for i, t in enumerate(texts)}
    phrases = d.phrase_rows(benchmark.selectExpr("cast(item_id as string) as item", "text"), 13).select("phrase", "terms")
    hashes = lambda *words: [int(x) for x in d.hashed([w.encode() for w in words], len(words))]
    lists = spark.createDataFrame([(0, hashes("the", "w3x1")), (1, hashes("the", "w3x1", "w4x1"))], "shard long, terms array<long>")
    assert d.wanted(phrases, lists, 10).count() == 0  # every phrase has a term that no shard has
    whole = [t for i in (3, 4) for t in items[i][1].split()]
    lists = spark.createDataFrame([(0, hashes(*whole[:20])), (1, hashes(*whole)), (2, hashes("the"))], "shard long, terms array<long>")
    met = {r["shard"]: len(r["phrases"]) for r in d.wanted(phrases, lists, 1000).collect()}
    assert met == {0: 8, 1: 16}


def test_proximity(spark, docs):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    frame = docs((1, "gamma of alpha and beta"), (2, "alpha x x x x x x x beta gamma"), (3, "alpha beta gamma"))
    found = {r.doc_id: [(h["first"], h["last"], h.near) for h in r.hits] for r in d.occurrences(frame, benchmark, slack=2).collect()}
    assert found == {1: [(0, 4, True)], 2: [], 3: [(0, 2, False), (0, 2, True)]}


def test_query_digest(spark, base):
    rows = d.op6(spark, base).collect()
    assert any(r.contaminated for r in rows)
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
