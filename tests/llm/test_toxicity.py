import zlib

import numpy as np
from pyspark.sql import functions as F

from resona.llm import toxicity


def sample(docs, n=200):
    rows = []
    for i in range(n):
        noise = " ".join(f"{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 26)}an" for k in range(1, 20))
        rows.append((i, noise + (" you vile rotter" if i % 3 == 0 else "")))
    return rows


def test_held_out_words_are_found(spark, docs):
    rows = sample(docs)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    extra = [(1000, None), (1001, ""), (1002, "a vile rotter came"), (1003, "you vile rotter " * 5000), (None, "vile rotter"), (3, rows[3][1])]
    found = toxicity.classify(docs(*rows, *extra), labels)
    assert found.count() == len(rows) + len(extra)
    got = {(r.doc_id, r.text): r for r in found.collect()}
    for i, text in rows:
        r = got[i, text]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(i % 3 == 0)
    assert got[1000, None].score == got[1001, ""].score and got[1001, ""].predicted == 0
    assert got[1002, extra[2][1]].predicted == got[1003, extra[3][1]].predicted == got[None, "vile rotter"].predicted == 1


def test_without_two_classes(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows = toxicity.classify(docs((1, "x"), (2, "y")), labels).collect()
    assert [r.predicted for r in rows] == [0, 0] and all(r.score < 1e-9 for r in rows)
    assert toxicity.classify(docs((1, "x")).limit(0), labels).collect() == []
    assert toxicity.classify(docs((1, "x")), labels.limit(0)).first().predicted == 0


def test_labels_of_held_out_documents_are_not_read(spark, docs):
    rows = sample(docs)
    right = [(i, int(i % 3 == 0)) for i, _ in rows]
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in right]
    scores = [
        [r.score for r in toxicity.classify(docs(*rows), spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect()]
        for x in (right, wrong)
    ]
    assert np.allclose(*scores)


def test_unseen_grams_have_no_weight():
    import pandas as pd

    ratio = toxicity.ratios(pd.DataFrame({"bucket": [5, 6], "n": [10, 40], "p": [10, 0]}), 20, 100)
    assert abs(ratio[0]) < 1e-12 and ratio[5] > 1 and ratio[6] < -1
