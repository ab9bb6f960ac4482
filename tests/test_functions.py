from pyspark.sql import functions as F

from resona.functions import text as T
from resona.functions import video as V
from resona.functions import words as W


def test_hashtags_keep_case_and_first_order(apply):
    assert apply(T.extract_hashtags, "#b #a-x #b #B ##été_1 # no") == ["b", "a", "B", "été_1"]
    assert apply(T.extract_hashtags, None) == []


def test_emojis_are_named_once(apply):
    assert apply(T.extract_emojis, "😂 a 😂💄") == ["face_with_tears_of_joy", "lipstick"]
    # outside the four ranges, and a flag letter that has no name of its own
    assert apply(T.extract_emojis, "🤣") == []
    assert apply(T.extract_emojis, "🇲") == ["🇲"]


def test_demojize_leaves_other_text(apply):
    assert apply(T.demojize, "so 😍!") == "so :smiling_face_with_heart-eyes:!"
    assert apply(T.demojize, "é ² x") == "é ² x"


def test_basic_cleaning(apply):
    text = "See HTTPS://x.y/z?a=1 @anna_1: #Tag Crème it's  50ml now 😍"
    # the word with an accent is dropped whole; the apostrophe splits a word
    assert apply(T.clean_text_basic, text) == "see it s 50ml now"
    assert apply(T.clean_text_basic, "#a-b") == "b"
    assert apply(T.clean_text_basic, None) == ""


def test_sentiment_cleaning_keeps_case(apply):
    assert apply(T.clean_text_sentiment, " Wow  http://a.b c @me!\n") == "Wow c !"


def test_actionability_cleaning(apply):
    # punctuation goes without leaving a space, so "don't" is no longer a stop word
    assert apply(T.clean_text_actionability, "I don't need THE life-changing 😍 www.x.y") == (
        "dont need lifechanging smiling_face_with_hearteyes"
    )


def test_cluster_cleaning(apply):
    assert apply(T.clean_text_cluster, "@bob #tag Love\\nthis a 123 spf50 rhythm shhhhhh!") == (
        "love this spf50"
    )
    assert apply(T.clean_text_cluster, None) == ""


def test_tokens(apply):
    assert apply(T.tokenize_reduce, "sooooo spf50 ab12 50ml") == ["sooo", "spf", "50", "ab12", "50ml"]


def test_slang_and_filters(apply):
    tokens = "array<string>"
    assert apply(T.expand_slang, ["omg", "tbh", "x"], tokens) == [
        "oh", "my", "god", "to", "be", "honest", "x"
    ]
    assert apply(T.drop_short_tokens, ["a", "x", "it"], tokens) == ["a", "it"]
    assert apply(T.drop_meaningless_tokens, ["12", "!!", "i", "z", "ok"], tokens) == ["i", "ok"]
    assert apply(lambda c: T.remove_stopwords(c, W.PRODUCT_STOP_WORDS), ["love", "serum"], tokens) == ["serum"]
    assert apply(T.lemmatize, ["Lipsticks", "serum"], tokens) == ["lipstick", "serum"]


def test_word_list_sizes():
    assert len(W.ENGLISH_STOP_WORDS) == len(set(W.ENGLISH_STOP_WORDS)) == 179
    assert len(W.SLANG) == 25 and len(W.PRODUCT_TERMS) == 15 and len(W.KEPT_SHORT_TOKENS) == 19


def test_too_short_and_boost(spark):
    df = spark.createDataFrame([("123456789",), ("1234567890",), (None,)], "x string")
    assert [r[0] for r in df.select(T.too_short(F.col("x"))).collect()] == [True, False, True]
    terms = spark.createDataFrame([("serum", 1.0), ("word", 1.0)], "t string, s double")
    got = [r[0] for r in terms.select(T.boost_terms(F.col("t"), F.col("s"))).collect()]
    assert got == [5.0, 1.0]


def test_video_id(apply):
    cases = {
        "https://h.example/watch?v=abc&t=1": "abc",
        "https://h.example/watch?v=a%20b+c": "a b c",
        "https://h.example/watch?v=&x=1#v=zz": None,
        "https://h.example/shorts/abc;p?x=1": "abc",
        "https://h.example/shorts/": "",
        "https://youtu.be/ABCDEFGHIJK": "ABCDEFGHIJK",
        "short": None,
    }
    got = {url: apply(V.video_id_from_url, url) for url in cases}
    assert got == cases


def test_embed_id(apply):
    assert apply(V.embed_id_from_url, "x?v=ABCDEFGHIJKL") == "ABCDEFGHIJK"
    assert apply(V.embed_id_from_url, "h/shorts/ABCDEFGHIJK") == "ABCDEFGHIJK"
    assert apply(V.embed_id_from_url, "h/embed/ABCDEFGHIJK") is None


def test_durations(apply):
    cases = {
        "PT1H2M3S": 3723.0, "P1DT2H": 93600.0, "P1M": 60.0, "P2W": 0.0, "P": 0.0, "bad": None,
        None: None, "PT15M": 900.0,
    }
    assert {d: apply(V.iso_duration_seconds, d) for d in cases} == cases


def test_topics(apply):
    urls = ["https://en.wikipedia.org/wiki/Beauty", "https://x.org/a", "wiki/wiki/Hair"]
    assert apply(V.topics_from_wiki_urls, urls, "array<string>") == ["Beauty", "Hair"]
    assert apply(V.topics_from_wiki_text, "['a/wiki/B', 'c/wiki/D']") == ["B", "D"]
    assert apply(V.topics_from_wiki_text, "a/wiki/B") == ["B"]
    assert apply(V.topics_from_wiki_text, None) == []


def test_coercion(apply):
    assert str(apply(V.coerce_date, "2024-02-29T10:00:00Z")) == "2024-02-29"
    assert apply(V.coerce_date, "2024-02-30") is None
    numbers = {"12": 12, "3.9": 3, "-3.9": -3, "n/a": 0, None: 0, "": 0, "inf": 0}
    assert {x: apply(V.coerce_int, x) for x in numbers} == numbers
    assert apply(V.coerce_int, float("nan"), "double") == 0


def test_combined_text_keeps_the_space_of_a_missing_part(spark):
    df = spark.createDataFrame([("t", None, ["a", "b"]), ("t", "d", None)], "t string, d string, g array<string>")
    got = [r[0] for r in df.select(V.combined_video_text(F.col("t"), F.col("d"), F.col("g"))).collect()]
    assert got == ["t  a b", "t d "]


def test_engagement_without_views(spark):
    df = spark.createDataFrame([(3, 2, 0), (3, 2, 10)], "l long, c long, v long")
    got = [r[0] for r in df.select(V.engagement_rate(F.col("l"), F.col("c"), F.col("v"))).collect()]
    assert got == [5.0, 0.5]


SEQUENCES = {
    "👍🏽": "thumbs_up_medium_skin_tone", "🇫🇷": "flag_fr", "👩‍💻": "woman_technologist", "1️⃣": "keycap_1",
    "👩🏿‍💻": "woman_technologist_dark_skin_tone", "#⃣": "keycap_#", "❤️": "red_heart", "💇‍♀️": "woman_getting_haircut",
    "🏴\U000E0067\U000E0062\U000E0073\U000E0063\U000E0074\U000E007F": "flag_gbsct", "😍": "smiling_face_with_heart-eyes",
    "👨‍👩‍👦": "man_woman_boy",
}


def test_each_emoji_sequence_has_one_name(apply):
    for sequence, name in SEQUENCES.items():
        assert apply(T.demojize, f"a{sequence}b") == f"a:{name}:b", name
        assert apply(T.demojize, sequence * 2) == f":{name}::{name}:", name
    text, names = " ".join(SEQUENCES), " ".join(f":{n}:" for n in SEQUENCES.values())
    assert apply(T.demojize, text) == names
    assert apply(T.demojize, text.replace(" ", "")) == names.replace(" ", "")
    assert apply(T.demojize, "🇫🇷🇩🇪🇫") == ":flag_fr::flag_de:🇫"
    assert apply(T.demojize, "12 # * plain\ntext") == "12 # * plain\ntext"
    assert apply(T.demojize, None) is None and apply(T.demojize, "") == ""


def test_named_sequences_come_first(apply):
    names = {"🇫🇷": "France", "👍": "yes", "👍🏽": "yes_indeed"}
    assert apply(lambda c: T.demojize(c, names), "🇫🇷👍🏽👍🏿👍") == ":France::yes_indeed::yes_dark_skin_tone::yes:"
    assert apply(T.extract_emojis, "👍🏽 🇫🇷 👩‍💻 1️⃣ 👍🏽 ☀") == sorted(SEQUENCES[e] for e in ("👍🏽", "🇫🇷", "👩‍💻", "1️⃣"))


def test_words_left_in_batches_equal_those_by_columns(spark):
    texts = [None, "", " ", "the serum\x85is\x1cnice　a", "where can i buy it it'll", "ünï the é", " the ", "x  y\n\nz"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    stop = W.ENGLISH_STOP_WORDS
    rows = df.select(
        T.without_words(F.col("x"), stop).alias("a"), F.array_join(T.remove_stopwords(T.split_words(F.col("x")), stop), " ").alias("b"),
    ).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_the_distribution_of_labels_scores_each_text_once(spark):
    from resona.operators import actionability as A
    from resona.operators.report import actionability_distribution

    df = spark.createDataFrame([("buy it now",), (None,), ("hello",)], "commenttext string")
    counted = actionability_distribution(A.actionability(df))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hits_by_automaton(") == 1
    given = spark.createDataFrame([("x",), (None,), ("x",), ("y",)], "actionability_label string")
    assert [tuple(r) for r in actionability_distribution(given).collect()] == [("x", 2), ("y", 1)]
