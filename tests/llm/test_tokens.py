import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resona.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


TEXTS = [
    None, "", " ", "a", "it's   we'll\n\n  they've " * 40, "x" * 3000, " " * 2500, "word " * 700,
    "a  <|endoftext|>b <|endoftext|><|endoftext|>  " * 60, "naïve 🙂🙂 日本語 ünï " * 90,
    "!?'s'll '''re " * 200, "q" * 1000 + " tail" * 200 + "\n" * 500 + "end", "1234567 " * 300,
]


def test_counts_equal_the_library_for_any_chunk(spark):
    rows = [(i % 5 if i % 4 else None, t, "x", 3) for i, t in enumerate(TEXTS + TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, N_TOKENS int")
    expected = sorted((len((t or "").encode()), library(t)) for _, t, *_ in rows)
    for chunk, overlap in [(64, 20), (200, 64), (1 << 15, 256)]:
        found = tokens.count_tokens(docs, PATH, chunk=chunk, overlap=overlap)
        assert found.columns == ["doc_id", "text", "row", "n_bytes", "n_tokens"]
        got = found.collect()
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == expected
        assert all(r["n_tokens"] == library(r["text"]) and r["row"] == "x" for r in got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "'ll", "'", "l", " ", "  ", "\n", "<|endoftext|>", "<|endo", "text|>", "é", "1", "!"]),
                min_size=30, max_size=90).map("".join))
def test_common_boundaries_are_those_of_the_whole_text(text):
    """The claim that splices rest on, by brute force at every cut."""
    behind = tokens.margin(SOURCE)
    place, before, total = tokens.boundaries(LIBRARY, text)
    true = dict(zip(place.tolist(), before.tolist()))
    for start in range(1, len(text), 7):
        end = min(len(text), start + 40)
        left, left_n, _ = tokens.boundaries(LIBRARY, text[:end])
        right, right_n, right_all = tokens.boundaries(LIBRARY, text[start:])
        left = {p: n for p, n in zip(left.tolist(), left_n.tolist()) if start <= p <= end - behind}
        for p, n in zip((right + start).tolist(), right_n.tolist()):
            if p in left:
                assert true[p] == left[p] and left[p] + right_all - n == total


def test_words_are_cut_as_by_the_library_for_all_code_points():
    """Every code point that this Python knows, behind a letter, a number and a sign; others are left to the library."""
    counter = tokens.Counter(SOURCE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in tokens.unassigned()]
    assert len(points) > 280_000 and "\u0378" in tokens.unassigned()
    for at in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}x " for c in points[at:at + 4000])
        ends = [b for _, (_, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert np.cumsum([len(w) for w in counter.words(text)]).tolist() == ends


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["'", "ll", " ", "\n", "a", "é", "<|endoftext|>", "\u0378"])).map("".join))
def test_remembered_words_count_as_in_the_library(text):
    counter = tokens.Counter(SOURCE)
    assert counter.count(text) == library(text)
    place, before, total = counter.boundaries(text)
    expected = tokens.boundaries(LIBRARY, text)
    assert (place.tolist(), before.tolist(), total) == (expected[0].tolist(), expected[1].tolist(), expected[2])


def test_a_task_remembers_so_many_words_only(monkeypatch):
    monkeypatch.setattr(tokens, "HELD_WORDS", 3)
    counter = tokens.Counter(SOURCE)
    text = "one two three four five one"
    assert counter.count(text) == library(text) and len(counter) <= 3


def test_tokenizers_without_provable_boundaries_encode_texts_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.margin(open(path, encoding="utf-8").read()) is None
    made = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in tokens.count_tokens(docs, path, chunk=64, overlap=32).collect():
        assert r["n_tokens"] == len(made.encode(r["text"] or "", add_special_tokens=False))


def test_margin_covers_special_tokens_and_refuses_overlapping_ones():
    made = json.loads(SOURCE)
    assert tokens.margin(SOURCE) == len("<|endoftext|>") + 4
    made["added_tokens"] = [made["added_tokens"][0] | {"content": "abab"}]
    assert tokens.margin(json.dumps(made)) is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(docs, PATH).collect() == []


def test_query_equals_the_library_on_whole_tables(spark, base):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = tokens.op12(spark, base)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)
    assert max(len(t or "") for t in texts.values()) > tokens.CHUNK or got.where(F.col("over_limit")).count()


def test_a_short_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        tokens.count_tokens(spark.createDataFrame([("a",)], "text string"), PATH, overlap=10)
