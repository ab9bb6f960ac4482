import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as pipeline
from resona.llm import bpe
from tests.llm.test_decontaminate import brute
from tests.llm.test_language import brute as brute_languages
from tests.llm.test_simhash import brute_classes, brute_fingerprint


def test_stages_by_brute_force(spark, base):
    """Each stage's rows from its own input: all by plain Python."""
    docs = spark.read.parquet(f"{base}/documents.parquet")
    outputs, given = [], docs
    for name, stage in pipeline.STAGES:
        path = pipeline.new_path(spark, name)
        stage(spark, given, base).write.parquet(path)
        given = spark.read.parquet(path)
        outputs.append({r.doc_id: r for r in given.collect()})
        if name != pipeline.STAGES[-1][0]:
            assert given.columns == docs.columns
    start = {r.doc_id: r for r in docs.collect()}

    rows = [(i, r.text, r.lang) for i, r in start.items()]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    found = dict(zip(start, brute_languages(rows, learned)))
    assert set(outputs[0]) == {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5}

    ids = sorted(outputs[0])
    label = brute_classes([brute_fingerprint(outputs[0][i].text) for i in ids], 2)
    assert set(outputs[1]) == {ids[x] for x in label} and len(outputs[1]) < len(outputs[0])

    seen = set()
    for i in sorted(outputs[1]):  # no run of 50 words of an uncut earlier document is left
        words = outputs[2][i].text.lower().split() if i in outputs[2] else []
        runs = {tuple(words[k:k + 50]) for k in range(len(words) - 49)}
        assert not runs & seen
        seen |= runs
        if i in outputs[2]:
            assert outputs[2][i].n_chars == len(outputs[2][i].text) <= outputs[1][i].n_chars

    items = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(outputs[3]) == {i for i, r in outputs[2].items() if not brute(r.text, items)[3]}

    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert set(outputs[4]) == set(outputs[3])
    for i, r in outputs[4].items():
        text = outputs[3][i].text
        assert r.ids == own.encode_ordinary(text)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_call_their_operators():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "passages", "decontamination", "encoding"]
    assert pipeline.ORACLE_SQL is None


def test_null_and_empty_documents(spark, docs, base):
    rows = [(None, None), (1, ""), (2, "the of and to in is this text"), (2, "the of and to in is this text"), (3, "the of and to in is this text")]
    frame = docs(*rows)
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, base)
    assert [r.doc_id for r in frame.collect()] == [2]
    empty = docs((1, "x")).limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, base)
    assert empty.collect() == []
