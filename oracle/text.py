"""DuckDB expressions of the text functions."""

from oracle.base import lit, pick
from resona.functions import linear
from resona.functions import patterns as P
from resona.functions import rules as R
from resona.functions import words as W


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def listed(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def pick_of(items, index):
    return pick(items, f"{index} % {len(items)}")


def strip(x):
    return sub(x, P.EDGE_SPACES)


def words_of(x):
    return f"[w FOR w IN string_split_regex({x}, {lit(P.SPACES)}) IF w <> '']"


def hashtags(x):
    found = f"regexp_extract_all(coalesce({x}, ''), {lit(P.HASHTAG)}, 1)"
    return f"[h FOR h, i IN {found} IF list_position({found}, h) = i]"


def clean_basic(x):
    t = f"lower(coalesce({x}, ''))"
    for pattern in (P.URL, P.MENTION, P.NOT_WORD_SPACE_HASH, P.HASHTAG):
        t = sub(t, pattern, " ")
    parts = f"string_split_regex({t}, {lit(P.SPACES)})"
    return f"array_to_string([w FOR w IN {parts} IF regexp_full_match(w, '[a-z0-9]+')], ' ')"


def clean_sentiment(x):
    t = sub(sub(f"coalesce({x}, '')", P.URL_PREFIX), P.MENTION)
    return f"trim({sub(t, P.SPACES, ' ')})"


NAMES = {k: v for k, v in W.emoji_names().items()}


def demojize(x, chars="😍💇😂"):
    """Only the pictographs that occur in the derived comments need a replacement here."""
    for ch in chars:
        x = f"replace({x}, {lit(ch)}, {lit(':' + NAMES[ch] + ':')})"
    return x


def clean_actionability(x):
    t = demojize(sub(f"coalesce({x}, '')", P.URL_PREFIX))
    t = f"lower({sub(t, P.NOT_WORD_SPACE)})"
    return f"array_to_string([w FOR w IN {words_of(t)} IF NOT list_contains({listed(W.ENGLISH_STOP_WORDS)}, w)], ' ')"


def clean_cluster(x):
    t = f"lower(replace(replace(coalesce({x}, ''), '\\n', ' '), '\\t', ' '))"
    t = sub(t, P.MENTION_OR_HASHTAG)
    t = sub(sub(t, P.SPACES, " "), "[^a-z0-9 ]")
    for pattern in (r"\b[^aeiou ]{6,}\b", r"\b[a-z0-9]\b", r"\b[0-9]+\b"):
        t = sub(t, pattern)
    return f"trim({sub(t, ' +', ' ')})"


def tokens(x):
    t = f"lower({x})"
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789":
        t = sub(t, ch * 3 + "+", ch * 3)
    return f"regexp_extract_all({t}, '[a-z]{{3,}}|[a-z0-9_]+')"


def mapped(table, key) -> str:
    return "(CASE " + key + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) \
        + f" ELSE {key} END)"


def slang(tokens_):
    return f"flatten([string_split({mapped(W.SLANG, 't')}, ' ') FOR t IN {tokens_}])"


def short_out(tokens_):
    return f"[t FOR t IN {tokens_} IF length(t) >= 2 OR list_contains({listed(W.KEPT_SHORT_TOKENS)}, t)]"


def stop_out(tokens_, stop=None):
    stop = W.ENGLISH_STOP_WORDS + W.PRODUCT_STOP_WORDS if stop is None else stop
    return f"[t FOR t IN {tokens_} IF NOT list_contains({listed(sorted(set(stop)))}, t)]"


def meaningless_out(tokens_):
    return (
        f"[t FOR t IN {tokens_} IF NOT regexp_full_match(t, '[0-9]+') AND regexp_matches(t, '[a-z0-9_]') "
        "AND (length(t) > 1 OR t = 'i' OR t = 'a')]"
    )


def lemmas(tokens_):
    return f"[{mapped(W.DEMO_LEMMAS, 't')} FOR t IN {tokens_}]"


def logit(tokens_, weights, bias):
    case = "(CASE t " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in weights.items()) + " ELSE 0 END)"
    total = f"coalesce(list_sum([CAST({case} AS DOUBLE) FOR t IN {tokens_}]), 0.0)"
    return f"({total} + {bias}::DOUBLE)"


def sigmoid(x):
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{x})))"


def spam_probability(x):
    return sigmoid(logit(words_of(clean_basic(x)), linear.SPAM_WEIGHTS, linear.SPAM_BIAS))


def positive_probability(x):
    plain = sub(f"lower({clean_sentiment(x)})", "[^a-z0-9]+", " ")
    return sigmoid(logit(words_of(plain), linear.SENTIMENT_WEIGHTS, linear.SENTIMENT_BIAS))


def portable(pattern):
    return pattern.replace(r"\w", P.WORD).replace(r"\s", P.SPACE)


def keyword_hits(x, category):
    return "(" + " + ".join(f"CAST(contains({x}, {lit(k)}) AS INTEGER)" for k in R.KEYWORDS[category]) + ")"


def pattern_hits(x, category):
    if not R.PATTERNS[category]:
        return "0"
    return "(" + " + ".join(
        f"CAST(regexp_matches({x}, {lit(portable(p))}) AS INTEGER)" for p in R.PATTERNS[category]) + ")"


def column_of(category):
    return category.lower().replace(" ", "_")


SPAM_CTES = [
    f"spam_text AS MATERIALIZED (SELECT *, lower({strip('coalesce(commenttext, {0})'.format(lit('')))}) AS t FROM comments)",
    f"spam_words AS MATERIALIZED (SELECT *, {words_of('t')} AS words, "
    "regexp_extract_all(t, '(?s).') AS chars FROM spam_text)",
    f"""spam_flags AS MATERIALIZED (SELECT commentid, commenttext,
      t = '' AS rule_a, length(t) > 500 AS rule_b,
      regexp_matches(t, '(http|www|\\.com|\\.net|\\.org|\\.info|\\.xyz)') AS rule_c,
      coalesce(list_max(map_values(list_histogram(words))), 0) > 10 AS rule_d,
      length(t) > 20 AND len([c FOR c IN chars IF regexp_matches(c, {lit(P.UPPERCASE)})]) / greatest(length(t), 1) > 0.8 AS rule_e,
      length(t) > 10 AND len(list_distinct(chars)) < 4 AS rule_f,
      len(words) < 2 AND length(t) < 5 AS rule_g,
      length(t) > 0 AND len([c FOR c IN chars IF NOT regexp_matches(c, {lit(P.ALPHANUMERIC)})]) / greatest(length(t), 1) > 0.8 AS rule_h,
      len(words) > 10 AND len(list_distinct(words)) < 3 AS rule_i,
      len([c FOR c IN chars IF c = '@']) > 5 AS rule_j
    FROM spam_words)""",
    """spam_first AS (SELECT *, CASE """
    + " ".join(f"WHEN rule_{r} THEN '{r}'" for r in "abcdefghij")
    + " END AS first_rule FROM spam_flags)",
]
