import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from resona.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    None, "", " ", "  \n\n x", "It's 123 o'clock, they'LL we'll go!!", "naïve Straße 漢字かな 🇫🇷👩‍💻", "\x00\x1c\x85\xa0　a",
    "<|endoftext|> is text", "a" * 5000, " " * 700, "the" * 400, "\r\n\t mixed ​﻿", "½²Ⅷ٠", "'s't're",
]


@pytest.mark.parametrize("known", [0, 5, 1000])
def test_equals_the_library(spark, docs, known):
    random.seed(known)
    made = ["".join(random.choices("abcdeé 1.\n'", k=40)) for _ in range(30)]
    texts = [*TEXTS, *made, *made[:3]]
    frame = docs(*enumerate(texts))
    rows = bpe.digests(bpe.encode(frame, PATH, PATTERN, known_words=known, sample=1 + known % 2), PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.key == "x"


def test_spark_fold_equals_the_library(spark):
    random.seed(3)
    words = [bytes(random.randrange(256) for _ in range(random.randint(1, 30))) for _ in range(200)]
    words = [w for w in dict.fromkeys(words) if w not in RANKS] + [b""]
    frame = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    for row in bpe.encode_words(frame, PATH).collect():
        word = bytes(row.word)
        assert row.ids == (LIBRARY._encode_single_piece(word) if word else [])


def test_array_fold_equals_the_library():
    random.seed(4)
    words = [bytes(random.choices(b"ab the", k=random.randint(0, 300))) for _ in range(300)]
    found = bpe.fold_words(words, RANKS, bpe.pair_rows(PATH))
    for word, ids in zip(words, found):
        if word not in RANKS:
            assert list(ids) == (LIBRARY._encode_single_piece(word) if word else [])


def test_empty_table(spark, docs):
    assert bpe.encode(docs((1, "x")).limit(0), PATH, PATTERN).collect() == []


def test_decoding_ignores_unknown_ids(spark):
    frame = spark.createDataFrame([([0, 10**6, 1],), (None,), ([],)], "ids array<int>")
    found = [r[0] for r in frame.select(bpe.decode(frame.ids, PATH)).collect()]
    assert [None if x is None else bytes(x) for x in found] == [b"!\"", None, b""]
