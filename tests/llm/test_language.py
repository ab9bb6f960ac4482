import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.llm import language


def test_held_out_accuracy(spark, base):
    found = language.op3(spark, base)
    truth = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_cases(spark, docs):
    rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(i, "le chat et le chien", "fr") for i in range(8, 16)]
    rows += [(20, None), (21, ""), (22, "123 !?"), (23, "the unseen dogs", None), (None, "le chien"), (20, "the the"), (24, "漢字", None)]
    found = language.identify(docs(*rows))
    assert found.count() == len(rows) and "x" not in {r.score for r in found.select("score").collect()}
    by_text = {r.text: (r.lang_pred, r.score) for r in found.collect()}
    assert by_text[None] == by_text[""] == by_text["123 !?"] == ("und", 0.0)
    assert by_text["the unseen dogs"][0] == "en" and by_text["le chien"][0] == "fr"
    assert by_text["漢字"] == ("en", pytest.approx(0.5))
    kept = language.with_known_language(docs(*rows)).select("text").distinct()
    assert {r.text for r in kept.collect()} == set(by_text) - {None, "", "123 !?"}


def test_empty_and_unlabelled_tables(spark, docs):
    assert language.identify(docs((1, "x")).limit(0)).collect() == []
    found = language.identify(docs((1, "some text")).withColumn("lang", F.lit(None).cast("string"))).first()
    assert (found.lang_pred, found.score) == ("und", 0.0)


def model_of(learned):
    """A model of {piece: score} by size for one language."""
    keys, scores = [], []
    for size in range(language.LONGEST_GRAM + 1):
        own = learned.get(size, {})
        found = language.hashed(list(own), size)
        keys.append(np.sort(found))
        scores.append(np.array([list(own.values())[i] for i in np.argsort(found)], np.float32).reshape(-1, 1))
    return language.Model(["a"], keys, scores)


def test_backoff_goes_from_words_to_shorter_grams():
    model = model_of({0: {"word": 1.0}, 4: {" wor": 2.0}, 1: {"o": 3.0, "z": 5.0}})
    found = model.vectors(["word", "words", "oo", "x", "oz"])[:, 0].tolist()
    assert found == [1.0, 2.0, 3.0, 0.0, 4.0]


def brute(rows, learned):
    """lang_pred and score by plain dictionaries over the documents that are learned from."""
    langs = sorted({lang for _, _, lang in learned})
    counts = {}
    for _, text, lang in learned:
        for word in language.words(text):
            for size in range(language.LONGEST_GRAM + 1):
                for piece in language.grams(word, size) if size else [word]:
                    counts.setdefault((size, piece), dict.fromkeys(langs, 0))[lang] += 1
    counts = {k: v for k, v in counts.items() if k[0] or sum(v.values()) >= language.MIN_WORD_COUNT}
    sums = {(size, x): sum(v[x] + language.SMOOTHING for k, v in counts.items() if k[0] == size) for size in range(6) for x in langs}
    score = {k: [math.log((v[x] + language.SMOOTHING) / sums[k[0], x]) for x in langs] for k, v in counts.items()}
    out = []
    for _, text, _ in rows:
        total = np.zeros(len(langs))
        found = language.words(text)
        for word in found:
            own = [score[0, word]] if (0, word) in score else []
            for size in range(language.LONGEST_GRAM, 0, -1):
                own = own or [score[size, g] for g in language.grams(word, size) if (size, g) in score]
            if own:
                total += np.mean(own, axis=0)
        if not found:
            out.append(("und", 0.0))
        else:
            best = int(total.argmax())
            out.append((langs[best], float(1 / np.exp(total - total[best]).sum())))
    return out


def test_query_equals_brute_force(spark, base):
    """All rows, held out or not, on the whole table: below the bound of the sample everything is learned from."""
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text", "lang").collect()]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op3(spark, base).collect()}
    for (doc, *_), (lang, score) in zip(rows, brute(rows, learned)):
        assert got[doc][0] == lang and got[doc][1] == pytest.approx(score, abs=1e-3)


def test_long_texts_and_clashing_names(spark):
    rows = [(i, "the cat and the dog " * (4000 if i == 3 else 1), "en", "x") for i in range(8)]
    rows += [(i, "le chat et le chien", "fr", "x") for i in range(8, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found string")
    clash = docs.withColumns({"found": F.lit("y"), "Score": F.lit("z")})
    found = language.identify(clash)
    assert found.columns == ["doc_id", "text", "lang", "_found", "found", "held_out", "lang_pred", "score"]
    assert all((r["_found"], r["found"], r["lang_pred"]) == ("x", "y", r["lang"]) for r in found.collect())
    kept = language.with_known_language(clash)
    assert kept.columns == clash.columns and kept.count() == 16
