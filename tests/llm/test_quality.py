import numpy as np
import pytest

from resona.llm import quality


def test_weights_part_good_from_bad(spark, base):
    rows = quality.op5(spark, base).toPandas()
    labels = spark.read.parquet(f"{base}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert both[both.quality == 1].log_weight.median() > both[both.quality == 0].log_weight.median()
    assert sorted(rows["rank"]) == list(range(1, len(rows) + 1))
    assert rows.sort_values("rank").gumbel_key.is_monotonic_decreasing
    assert (rows.selected == (rows["rank"] <= -(-len(rows) // 2))).all()


def test_brute_force_and_cases(spark, docs):
    texts = {1: "good words here", 2: "bad spam bad", 3: None, 4: "", 5: "good words again and words", None: "bad good"}
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 0), (5, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.resample(docs(*texts.items(), (1, texts[1])), labels).collect()
    assert len(rows) == 7 and sum(r.selected for r in rows) == 4
    def total(keys):
        return sum(np.bincount(quality.features(texts[k]), minlength=quality.BUCKETS) for k in keys).astype(float)
    ratio = quality.log_ratio(total([1, 1, 5]), total([1, 1, 2, 3, 4, 5, None]))
    for r in rows:
        own = quality.features(texts[r.doc_id])
        assert r.log_weight == pytest.approx(ratio[own].sum() if len(own) else 0.0)
    assert len({r.gumbel_key for r in rows if r.doc_id == 1}) == 1


def test_empty_and_unlabelled(spark, docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.resample(docs((1, "x")).limit(0), labels).collect() == []
    assert [r.log_weight for r in quality.resample(docs((1, "x y")), labels).collect()] == [0.0]


def test_long_texts_weigh_by_all_their_ngrams(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    texts = {1: "good text " * 200, 2: "good text " * 5000, 3: "other " * 900}
    total = lambda keys: sum(np.bincount(quality.features(texts[k]), minlength=quality.BUCKETS) for k in keys).astype(float)
    ratio = quality.log_ratio(total([1]), total([1, 2, 3]))
    for most in (None, 128):
        rows = quality.resample(docs(*texts.items()), labels, most_ngrams=most).collect()
        for r in rows:
            own = quality.features(texts[r.doc_id])
            assert r.log_weight == pytest.approx(ratio[own].sum() * (1 if most is None else min(1, most / len(own))))
    weight = {r.doc_id: r.log_weight for r in rows}
    assert weight[1] == pytest.approx(weight[2], rel=0.05) and weight[3] < 0 < weight[1]


def test_query_equals_plain_ratio(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{base}/labels.parquet").filter("quality = 1").collect()}
    total = lambda keys: sum(np.bincount(quality.features(texts[k]), minlength=quality.BUCKETS) for k in keys).astype(float)
    ratio = quality.log_ratio(total([k for k in texts if k in good]), total(texts))
    rows = quality.op5(spark, base).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.log_weight == pytest.approx(ratio[quality.features(texts[r.doc_id])].sum(), abs=1e-6)


def test_many_copies_are_ranked_one_by_one(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality.resample(docs(*[(1, "same text")] * 300, (2, "other")), labels).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 302)) and sum(r.selected for r in rows) == 151


def test_draws_follow_the_weights(spark):
    frame = spark.range(20_000).selectExpr("id", "cast(id % 2 as double) as w")
    picked = frame.withColumn("k", frame.w * np.log(3) + quality.gumbel(frame.id)).orderBy("k", ascending=False).limit(200)
    assert 0.65 < picked.agg({"w": "avg"}).first()[0] < 0.85
