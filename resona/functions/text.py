"""Text columns: extraction, cleaning, tokens. Null text counts as empty text throughout."""

import json
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from resona.functions import patterns as P
from resona.functions import words as W


def lookup(table: Mapping, value_type: str = "string") -> Callable[[Column], Column]:
    """Function from a column of keys to their values in a fixed table, null if there is none.

    The table is one constant map, folded once when the query is planned. It travels with the tasks and a
    lookup goes through its keys, so it is meant for dictionaries, not for data.
    """
    constant = F.from_json(F.lit(json.dumps(dict(table))), f"map<string,{value_type}>")
    return lambda key: F.element_at(constant, key)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(P.SPACE_LIST))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, P.SPACES, " "))


def split_words(text: Column) -> Column:
    """Words between spaces; blank text gives an empty array."""
    return F.filter(F.split(text, P.SPACES), lambda w: w != "")


def extract_hashtags(text: Column) -> Column:
    """Hashtags without `#`, case kept, first occurrence of each, in order."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(P.HASHTAG), 1))


def emoji_name(sequence: Column, names: Mapping[str, str] | None = None) -> Column:
    """The name of one emoji of any number of code points; itself if it has none.

    A sequence that `names` lists has that name. Else it is made up: `flag_fr`, `keycap_1`; of joined elements the
    name of a person at work (`woman_technologist`), of a person of a gender (`woman_running`), or all names one after
    the other; with the skin tones behind it.
    """
    given = W.emoji_names() if names is None else names
    name_of, person, work, sign, tone = (lookup(t) for t in (given, W.PERSONS, W.OCCUPATIONS, W.SIGNS, W.TONES))
    plain = F.regexp_replace(F.regexp_replace(sequence, P.VARIANT, ""), P.TONE, "")
    parts = F.split(plain, P.JOINER)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    known = F.transform(parts, name_of)
    pair = F.size(parts) == 2
    base = F.coalesce(
        name_of(plain),
        F.when(pair & person(first).isNotNull() & work(second).isNotNull(),
               F.concat_ws("_", person(first), work(second))),
        F.when(pair & sign(second).isNotNull(),
               F.concat_ws("_", sign(second), F.regexp_replace(name_of(first), "^person_", ""))),
        F.when(F.size(parts) > 1, F.when(F.forall(known, lambda n: n.isNotNull()), F.array_join(known, "_"))),
    )
    tones = F.array_distinct(F.regexp_extract_all(sequence, F.lit(P.TONE), 0))
    toned = F.when(base.isNotNull(), F.concat_ws("_", base, F.array_join(F.transform(tones, tone), "_")))
    letters = F.transform(F.split(sequence, ""), lambda c: F.char(F.ascii(c) - 0x1F1E6 + ord("a")))
    tagged = F.transform(F.slice(F.split(sequence, ""), 2, F.length(sequence) - 2), lambda c: F.char(F.ascii(c) - 0xE0000))
    return F.coalesce(
        name_of(sequence),
        F.when(sequence.rlike(f"^{P.FLAG_LETTER}{{2}}$"), F.concat(F.lit("flag_"), F.array_join(letters, ""))),
        F.when(sequence.rlike(f"^{P.KEYCAP}$"), F.concat(F.lit("keycap_"), F.substring(sequence, 1, 1))),
        F.when(sequence.rlike(f"^{P.TAG_FLAG}$"), F.concat(F.lit("flag_"), F.array_join(tagged, ""))),
        F.when(F.size(tones) > 0, toned).otherwise(base),
        sequence,
    )


def extract_emojis(text: Column, names: Mapping[str, str] | None = None) -> Column:
    """Names of the distinct emoji in a text, sorted (the order carries no meaning). A sequence of several code
    points is one emoji."""
    raw = text_or_empty(text).cast("binary")  # every emoji has the first byte in UTF-8, every keycap the three
    possible = F.contains(raw, F.lit(b"\xf0")) | F.contains(raw, F.lit(b"\xe2\x83\xa3"))
    sequences = F.regexp_extract_all(F.when(possible, text).otherwise(""), F.lit(P.EMOJI_SEQUENCE), 0)
    found = F.array_distinct(F.filter(sequences, lambda e: e.rlike(f"^(?:{P.EMOJI}|{P.KEYCAP})")))
    return F.array_sort(F.array_distinct(F.transform(found, lambda e: emoji_name(e, names))))


def demojize(text: Column, names: Mapping[str, str] | None = None) -> Column:
    """Replace each emoji by `:name:`; a sequence of several code points (skin tones, joiners, flags, keycaps) is one,
    the longest first, and neighbours stay apart. One without a name stays."""
    def spelled(piece: Column) -> Column:
        name = emoji_name(piece, names)
        return F.when(name == piece, piece).otherwise(F.concat(F.lit(":"), name, F.lit(":")))

    def replaced(t: Column) -> Column:
        # In UTF-8 every sequence has one of these bytes; most texts have none, and a look for a byte is cheap.
        raw = t.cast("binary")
        possible = F.contains(raw, F.lit(b"\xf0")) | F.contains(raw, F.lit(b"\xe2"))
        pieces = F.regexp_extract_all(t, F.lit(f"(?s){P.EMOJI_SEQUENCE}|."), 0)
        return F.when(
            possible & t.rlike(P.EMOJI_SEQUENCE),
            F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{P.EMOJI_SEQUENCE}$"), spelled(p)).otherwise(p)), ""),
        ).otherwise(t)

    return computed_once(text, replaced)


def clean_text_basic(text: Column) -> Column:
    """Lower-case plain words `[a-z0-9]+`: links, mentions, hashtags and other signs are dropped."""
    t = F.lower(text_or_empty(text))
    t = F.regexp_replace(t, P.URL, " ")
    t = F.regexp_replace(t, P.MENTION, " ")
    t = F.regexp_replace(t, P.NOT_WORD_SPACE_HASH, " ")
    t = F.regexp_replace(t, P.HASHTAG, " ")
    return F.array_join(F.filter(F.split(t, P.SPACES), lambda w: w.rlike("^[a-z0-9]+$")), " ")


def clean_text_sentiment(text: Column) -> Column:
    """Drop links and mentions, collapse spaces; case and punctuation stay."""
    return collapse_spaces(without_links_and_mentions(text))


def without_links_and_mentions(text: Column) -> Column:
    """Both are looked for only in texts that can hold them."""
    whole = text_or_empty(text)
    linked = F.contains(whole, F.lit("http")) | F.contains(whole, F.lit("www"))
    mentions = F.contains(whole, F.lit("@"))
    unlinked = F.when(linked, F.regexp_replace(whole, P.URL_PREFIX, "")).otherwise(whole)
    return F.when(mentions, F.regexp_replace(unlinked, P.MENTION, "")).otherwise(unlinked)


def clean_text_actionability(
    text: Column,
    stop_words: Iterable[str] = W.ENGLISH_STOP_WORDS,
    names: Mapping[str, str] | None = None,
) -> Column:
    """Links out, emoji spelled out, punctuation removed, lower case, stop words out."""

    def unlinked(t: Column) -> Column:
        linked = F.contains(t, F.lit("http")) | F.contains(t, F.lit("www"))
        return F.when(linked, F.regexp_replace(t, P.URL_PREFIX, "")).otherwise(t)

    t = demojize(computed_once(text_or_empty(text), unlinked), names)
    return without_words(F.lower(F.regexp_replace(t, P.NOT_WORD_SPACE, "")), stop_words)


def without_words(text: Column, stop_words: Iterable[str]) -> Column:
    """The words of a lower-case text that are not in the list, joined by spaces: the same as
    `array_join(remove_stopwords(split_words(text), stop_words), " ")`, in Arrow batches."""
    stop = sorted(set(stop_words))

    def kept(texts: pa.Array) -> pa.Array:
        lists = pc.utf8_split_whitespace(texts)
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        encoded = lists.flatten().dictionary_encode()
        names = encoded.dictionary
        wanted = pc.invert(pc.is_in(names, value_set=pa.array([*stop, ""], names.type))).to_numpy(zero_copy_only=False)
        chosen = wanted[encoded.indices.to_numpy(zero_copy_only=False)]
        ends = np.append(0, np.cumsum(np.bincount(rows[chosen], minlength=len(lists))))
        words = lists.flatten().filter(pa.array(chosen))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), pa.scalar(" ", words.type))
        return pc.if_else(pc.is_valid(texts), joined, pa.scalar(None, joined.type))

    return F.arrow_udf(kept, "string")(text)


# Words that say nothing about a group: runs of six and more without a vowel, single characters, numbers.
UNWANTED = "[b-df-hj-np-tv-z0-9]{6,}|[a-z0-9]|[0-9]+"


def plain_text_cluster(text: Column) -> Column:
    """Lower-case ASCII words between white space, without mentions and hashtags."""
    t = F.replace(F.replace(text_or_empty(text), F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" "))
    t = F.lower(t)
    t = F.when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("#")), F.regexp_replace(t, P.MENTION_OR_HASHTAG, "")).otherwise(t)
    return F.regexp_replace(t, f"[^a-z0-9{P.SPACE_CHARS}]+", "")


def drop_unwanted_words(plain: Column) -> Column:
    # Only plain words are left, so the three kinds of unwanted words can go in one pass.
    return collapse_spaces(F.regexp_replace(plain, rf"\b(?:{UNWANTED})\b", ""))


def clean_text_cluster(text: Column) -> Column:
    """ASCII words of two or more characters for grouping: no mentions, hashtags, numbers, or
    vowel-less runs of six and more."""
    return drop_unwanted_words(plain_text_cluster(text))


def tokenize_reduce(text: Column) -> Column:
    """Tweet-style tokens of cleaned text: repeats of three and more shortened to three, and a run of
    three or more letters split from digits after it."""
    t = F.regexp_replace(F.lower(text_or_empty(text)), r"(.)\1{2,}", "$1$1$1")
    return F.regexp_extract_all(t, F.lit("[a-z]{3,}|[a-z0-9_]+"), 0)


def expand_slang(tokens: Column, slang: Mapping[str, str] = W.SLANG) -> Column:
    """Replace abbreviations; an expansion of several words becomes several tokens."""
    meaning = lookup(slang)
    return F.flatten(
        F.transform(tokens, lambda t: F.split(F.coalesce(meaning(F.lower(t)), t), " "))
    )


def drop_short_tokens(
    tokens: Column, min_length: int = 2, keep: Iterable[str] = W.KEPT_SHORT_TOKENS
) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= min_length) | t.isin(*keep))


def remove_stopwords(tokens: Column, stop_words: Iterable[str]) -> Column:
    stop = sorted(set(stop_words))
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stop))


def drop_meaningless_tokens(tokens: Column) -> Column:
    """Drop numbers, bare punctuation and single characters other than `i` and `a`."""
    return F.filter(
        tokens,
        lambda t: ~t.rlike(r"^\p{N}+$")
        & t.rlike(f"{P.WORD}")
        & ((F.length(t) > 1) | t.isin("i", "a")),
    )


def lemmatize(tokens: Column, lemmas: Mapping[str, str] = W.DEMO_LEMMAS) -> Column:
    """Dictionary form of each token; tokens without an entry stay as they are."""
    form = lookup(lemmas)
    return F.transform(tokens, lambda t: F.coalesce(form(F.lower(t)), F.lower(t)))


def too_short(cleaned: Column, min_length: int = 10) -> Column:
    return F.length(F.coalesce(cleaned, F.lit("<empty>"))) < min_length


def boost_terms(
    term: Column,
    score: Column,
    terms: Iterable[str] = W.PRODUCT_TERMS,
    factor: float = W.PRODUCT_TERM_FACTOR,
) -> Column:
    return F.when(term.isin(*terms), score * F.lit(factor)).otherwise(score)
