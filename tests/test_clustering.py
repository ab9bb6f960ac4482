import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from resona.functions import text as T
from resona.operators import clustering as K
from resona.operators import kmeans, tfidf

TEXTS = [
    "hydrating serum texture", "hydrating serum glow", "serum texture cream", "matte lipstick shade",
    "lipstick shade red", "matte lipstick red shade", "shampoo curl shine", "curl shine shampoo soft",
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(f"c{i}", t.split(), t, i // 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows + [("none", [], "", None)],
        "commentid string, tokens array<string>, textcleaned string, cluster int",
    )


def reference_tfidf(texts, max_features=1000, max_df=0.8):
    """Smoothed idf, unit length, the most frequent terms: the textbook formula in plain Python."""
    grams = [t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])] for t in texts]
    n, df, cf = len(texts), Counter(), Counter()
    for g in grams:
        df.update(set(g))
        cf.update(g)
    vocab = sorted((t for t in cf if df[t] <= max_df * n), key=lambda t: (-cf[t], t))[:max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for g in grams:
        w = {t: c * idf[t] for t, c in Counter(g).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        out.append({t: x / norm for t, x in w.items()})
    return vocab, out


@pytest.mark.parametrize("max_features", [1000, 7])
def test_tfidf_formula(tokens, max_features):
    terms = tokens.withColumn("terms", tfidf.ngrams(F.col("tokens")))
    model = tfidf.fit(terms, "terms", max_features)
    vocab, weights = reference_tfidf(TEXTS, max_features)
    assert model.terms == vocab
    got = tfidf.term_weights(model.transform(terms, "terms"), ["commentid"], model).collect()
    flat = {(r["commentid"], r["term"]): r["weight"] for r in got}
    wanted = {(f"c{i}", t): w for i, row in enumerate(weights) for t, w in row.items()}
    assert flat.keys() == wanted.keys()
    assert all(abs(flat[k] - wanted[k]) < 1e-12 for k in wanted)


def test_terms_in_almost_every_document_are_dropped(spark):
    df = spark.createDataFrame([(["aa", "bb"],), (["aa"],), (["aa", "cc"],)], "t array<string>")
    assert "aa" not in tfidf.fit(df, "t").terms


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 0.3, (12, 3)) for c in (0, 3, 7)])
    rows = [(i, [float(x) for x in p], i // 12) for i, p in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, v array<double>, cluster int")
    return data, df.withColumn("features", array_to_vector("v"))


def test_silhouette_equals_all_pairs(points):
    data, df = points
    labels = np.repeat([0, 1, 2], 12)
    d = ((data[:, None] - data[None]) ** 2).sum(-1)
    scores = []
    for i, own in enumerate(labels):
        a = d[i][labels == own].sum() / ((labels == own).sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    assert abs(K.silhouette(df) - np.mean(scores)) < 1e-9


def test_assignment_and_representatives_by_brute_force(points):
    data, df = points
    centre = {c: data[c * 12:(c + 1) * 12].mean(0) for c in range(3)}
    got = {r["id"]: r["cluster"] for r in K.kmeans_assign(df.drop("cluster"), K.centroids(df)).collect()}
    assert got == {i: min(centre, key=lambda c: ((p - centre[c]) ** 2).sum()) for i, p in enumerate(data)}
    rows = K.cluster_representatives(df, "id").collect()
    for c in range(3):
        near = sorted(range(c * 12, c * 12 + 12), key=lambda i: np.linalg.norm(data[i] - centre[c]))[:3]
        assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["cluster"] == c] == near


def test_choose_k_finds_the_groups(points):
    _, df = points
    rows, model = K.choose_k(df.drop("cluster"), "id", restarts=3)
    assert [r[0] for r in rows if r[2]] == [3] and len(model.centres) == 3
    assert all(-1 <= score <= 1 for _, score, _ in rows)


def test_choose_k_with_too_few_rows(points):
    _, df = points
    rows, _ = K.choose_k(df.drop("cluster").limit(1), "id", restarts=2)
    assert rows == [(2, -1.0, True)]


def test_weights_stand_for_copies(spark):
    rows = [([0.0, 0.0], 5.0), ([0.0, 1.0], 1.0), ([5.0, 5.0], 1.0), ([5.0, 6.0], 9.0)]
    df = spark.createDataFrame(rows, "v array<double>, weight double").withColumn(
        "features", array_to_vector("v"))
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    keyed = copies.withColumn("key", F.concat_ws(" ", "v", "i"))
    both = [
        K.fit_kmeans(df, [2], "v", weight="weight", restarts=3)[2], K.fit_kmeans(keyed, [2], "key", restarts=3)[2],
    ]
    assert sorted(both[0].centres.round(9).tolist()) == sorted(both[1].centres.round(9).tolist())
    assert abs(both[0].cost - both[1].cost) < 1e-9


def lloyd(data, weights, centres, steps):
    """k-means steps by the book; centres without points stay."""
    for _ in range(steps):
        near = ((data[:, None] - centres[None]) ** 2).sum(-1).round(9).argmin(1)
        centres = np.array([
            np.average(data[near == j], axis=0, weights=weights[near == j]) if (near == j).any() else c
            for j, c in enumerate(centres)
        ])
    d = ((data[:, None] - centres[None]) ** 2).sum(-1)
    return centres, (weights * d.min(1)).sum()


def test_all_models_at_once_equal_separate_fits(spark):
    rng = np.random.default_rng(3)
    data, weights = rng.normal(0, 1, (80, 5)), rng.integers(1, 9, 80).astype(float)
    rows = [(f"t{i}", [float(x) for x in p], float(w)) for i, (p, w) in enumerate(zip(data, weights))]
    df = spark.createDataFrame(rows, "id string, v array<double>, weight double").repartition(5)
    found = kmeans.points(df.withColumn("features", array_to_vector("v")), "id", weight="weight").cache()
    ks = [2, 3, 4, 5, 6]
    together = kmeans.fit_all(found, ks, restarts=4, seed=7, max_iter=6)
    starts = kmeans.draw(found, 5, 6, 4, 7)
    for start, drawn in enumerate(starts):
        assert drawn.shape == (6, 5) and len({tuple(p) for p in drawn}) == 6
        assert {tuple(p.round(9)) for p in drawn} <= {tuple(p.round(9)) for p in data}
        for k in ks:
            centres, cost = lloyd(data, weights, drawn[:k], 6)
            model = together[k, start]
            assert np.allclose(model.centres, centres) and abs(model.cost - cost) < 1e-6
    for k in ks:
        alone = kmeans.fit_all(found, [k], restarts=4, seed=7, max_iter=6)
        assert all(abs(alone[k, r].cost - together[k, r].cost) < 1e-6 for r in range(4))
    best = kmeans.best_per_k(together)
    assert all(best[k].cost <= min(together[k, r].cost for r in range(4)) + 1e-6 for k in ks)
    scores = kmeans.silhouettes(found, best)
    for k in ks:
        near = ((data[:, None] - best[k].centres[None]) ** 2).sum(-1).argmin(1)
        rows = [([float(x) for x in p], int(c)) for p, c, w in zip(data, near, weights) for _ in range(int(w))]
        copies = spark.createDataFrame(rows, "v array<double>, cluster int").withColumn("features", array_to_vector("v"))
        assert abs(scores[k] - K.silhouette(copies)) < 1e-6  # a weight stands for so many rows
    found.unpersist()


def test_models_take_one_scan_per_step(spark, points, monkeypatch):
    _, df = points
    found, scans = kmeans.points(df, "id"), []
    add_up = kmeans._add_up
    monkeypatch.setattr(kmeans, "_add_up", lambda *args: scans.append(1) or add_up(*args))
    models = kmeans.fit_all(found, [2, 3, 4, 5, 6], restarts=10, max_iter=8)
    assert len(models) == 50 and len(scans) <= 8 + 1  # the last one finds costs and sizes


def test_fewer_points_than_clusters_and_equal_points(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "id string, v array<double>")
    models = kmeans.fit_all(kmeans.points(df.withColumn("features", array_to_vector("v")), "id"), [2, 3], restarts=2)
    assert all(len(m.centres) == 1 and m.cost == 0 and m.sizes.tolist() == [2.0] for m in models.values())


def test_keyphrases_equal_greedy_selection(spark, tokens):
    terms = tokens.withColumn("terms", tfidf.ngrams(F.col("tokens")))
    model = tfidf.fit(terms, "terms")
    vectors = model.transform(terms, "terms")
    counts: list[int] = []
    got = K.cluster_keyphrases(vectors, model, n=5, scored_per_round=counts).collect()
    every = vectors.select("cluster", F.explode(F.array_distinct("terms"))).where("cluster IS NOT NULL").distinct().count()
    assert len(counts) == 4 and all(c < every for c in counts) and counts[-1] < counts[0]
    index = {t: i for i, t in enumerate(model.terms)}
    for cluster in (0, 1, 2):
        rows = [t.split() for i, t in enumerate(TEXTS) if i // 3 == cluster]

        def vector(words):
            v = np.zeros(len(index))
            for g in words + [" ".join(p) for p in zip(words, words[1:])]:
                if g in index:
                    v[index[g]] += model.idf[index[g]]
            return v / (np.linalg.norm(v) or 1)

        centre = np.mean([vector(r) for r in rows], axis=0)
        phrases = {g: vector(g.split()) for r in rows for g in r + [" ".join(p) for p in zip(r, r[1:])]}
        rel = {p: round(float(v @ centre / np.linalg.norm(centre)), 9) for p, v in phrases.items()}
        picked = [min(rel, key=lambda p: (-rel[p], p))]
        while len(picked) < min(5, len(phrases)):
            rest = {p: round(0.5 * rel[p] - 0.5 * max(float(phrases[p] @ phrases[q]) for q in picked), 9)
                    for p in phrases if p not in picked}
            picked.append(min(rest, key=lambda p: (-rest[p], p)))
        mine = [r["phrase"] for r in sorted(got, key=lambda r: r["rank"]) if r["cluster"] == cluster]
        assert mine == picked


def test_lazy_keyphrases_score_few_of_many_candidates(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(400)]
    rows = [(int(rng.integers(0, 3)), [words[int(x)] for x in rng.zipf(1.4, 14) if x < 400]) for _ in range(250)]
    df = spark.createDataFrame(rows, "cluster int, tokens array<string>").withColumn("terms", tfidf.ngrams(F.col("tokens")))
    model = tfidf.fit(df, "terms")
    vectors = model.transform(df, "terms")
    counts: list[int] = []
    got = K.cluster_keyphrases(vectors, model, n=6, scored_per_round=counts).collect()
    every = vectors.select("cluster", F.explode("terms").alias("t")).distinct()
    assert sum(counts) < 0.5 * 5 * every.count()
    centres = {r["cluster"]: np.array(r["centre"]) for r in K.centroids(vectors).collect()}
    index = {t: i for i, t in enumerate(model.terms)}
    for cluster, centre in centres.items():
        phrases = {}
        for (t,) in every.where(F.col("cluster") == cluster).select("t").collect():
            v = np.zeros(len(index))
            for g in dict.fromkeys([*t.split(), t]):
                if g in index:
                    v[index[g]] += model.idf[index[g]] * (2 if t.split() == [g, g] else 1)
            phrases[t] = v / (np.linalg.norm(v) or 1)
        rel = {p: float(v @ centre / np.linalg.norm(centre)) for p, v in phrases.items()}
        picked = [min(rel, key=lambda p: (-round(rel[p], 9), p))]
        while len(picked) < 6:
            rest = {p: round(0.5 * rel[p] - 0.5 * max(float(phrases[p] @ phrases[q]) for q in picked), 9)
                    for p in phrases if p not in picked}
            picked.append(min(rest, key=lambda p: (-rest[p], p)))
        assert [r["phrase"] for r in sorted(got, key=lambda r: r["rank"]) if r["cluster"] == cluster] == picked


def test_top_terms_have_positive_scores(tokens):
    terms = tokens.where("cluster IS NOT NULL").withColumn("terms", tfidf.ngrams(F.col("tokens")))
    model = tfidf.fit(terms, "terms")
    rows = K.cluster_top_terms(model.transform(terms, "terms"), model, n=4).collect()
    assert len(rows) == 12 and all(r["score"] > 0 for r in rows)


def test_labels_by_cosine_with_representatives(spark):
    texts = [
        (0, "lipstick mascara"), (0, "serum"), (1, "plain words"), (2, "curl shampoo"), (3, "serum serum lipstick"),
        (4, "lipstick serum"),
    ]
    df = spark.createDataFrame([(c, t.split()) for c, t in texts], "cluster int, tokens array<string>")
    model = K.fit_terms(df)
    labels = K.label_clusters(K.add_vectors(df, model), model)
    got = dict(labels.collect())

    def brute(cluster):
        index = {t: i for i, t in enumerate(model.terms)}
        total = np.zeros(len(index))
        for c, t in texts:
            if c == cluster:
                v, words = np.zeros(len(index)), t.split()
                for g in words + [" ".join(p) for p in zip(words, words[1:])]:
                    if g in index:
                        v[index[g]] += model.idf[index[g]]
                total += v / (np.linalg.norm(v) or 1)
        scores = {}
        for name, listed in K.PROTOTYPES.items():
            p = np.zeros(len(index))
            for t in listed:
                if t in index:
                    p[index[t]] = model.idf[index[t]]
            scores[name] = round(float(total @ p / (np.linalg.norm(p) or 1)), 9)
        best = max(scores, key=scores.get)
        return best if scores[best] > 0 else "others"

    assert got == {c: brute(c) for c in range(5)}
    assert got[1] == "others" and got[2] == "Hair treatment" and got[3] == "Skin care"
    rows = spark.createDataFrame([(0,), (1,), (None,), (7,)], "cluster int")
    named = {r["cluster"]: r["cluster_label"] for r in K.apply_cluster_label(rows, labels).collect()}
    assert named == {0: got[0], 1: "others", None: "others", 7: "others"}


def test_a_saved_model_gives_the_same_labels(spark, tmp_path):
    df = comments(spark, TEXTS * 3 + ["", None, "ok", "!!!"])
    model = K.fit_clusters(df, restarts=2, max_k=3)
    model.save(spark, str(tmp_path))
    model.save(spark, str(tmp_path))
    again = K.ClusterModel.load(spark, str(tmp_path))
    assert again == model and len(again.centres) == len(again.categories) >= 2
    first, second = (sorted(map(tuple, m.apply(df).collect()), key=str) for m in (model, again))
    assert first == second == sorted(map(tuple, K.product_clusters(df, restarts=2, max_k=3).collect()), key=str)
    plan = again.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_an_empty_model_can_be_saved(spark, tmp_path):
    model = K.fit_clusters(comments(spark, ["", None]))
    model.save(spark, str(tmp_path))
    again = K.ClusterModel.load(spark, str(tmp_path))
    assert [r["cluster_label"] for r in again.apply(comments(spark, ["a lovely lipstick"])).collect()] == ["others"]


def comments(spark, texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "commentid string, commenttext string")


def test_product_clusters_keep_every_row(spark):
    df = comments(spark, TEXTS * 3 + ["", None, "ok", "!!!"])
    rows = K.product_clusters(df, restarts=2, max_k=3).collect()
    assert sorted(r["commentid"] for r in rows) == sorted(f"c{i}" for i in range(28))
    labels = {r["commenttext"]: r["cluster_label"] for r in rows}
    assert labels[""] == labels[None] == labels["ok"] == "others"
    assert {labels[t] for t in TEXTS} & set(K.PROTOTYPES)


@pytest.mark.parametrize("texts", [["", None], ["single lonely comment"], []])
def test_product_clusters_without_a_vocabulary(spark, texts):
    rows = K.product_clusters(comments(spark, texts) if texts else comments(spark, ["x"]).limit(0)).collect()
    assert [r["cluster_label"] for r in rows] == ["others"] * len(texts)


ODD_TEXTS = [
    None, "", "  ", "soooo goood 😍 #tag @me spf50 xxrtzk 12 a i u r2 luv idk w/ tbh products\\nserum cream toner", "ÀÉ İx Kelvin shades",
    "aaaa1111bbbb 3ce c3po brb123 the_end under_score", "serum\x85cream\x1cgel 　 lip-stick #a#b @c@d e@f", "2 4 w/ b4 plz omg",
]


def test_tokens_in_batches_equal_those_by_columns(spark):
    df = comments(spark, ODD_TEXTS + TEXTS)
    both = df.select(
        K.reduced_tokens(T.plain_text_cluster(F.col("commenttext"))).alias("a"),
        K.tokens_by_columns(T.clean_text_cluster(F.col("commenttext"))).alias("b"),
        K.reduced_tokens(T.plain_text_cluster(F.col("commenttext")), lemmas=None).alias("c"),
        K.tokens_by_columns(T.clean_text_cluster(F.col("commenttext")), lemmas=None).alias("d"),
    ).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in both) and any(r["a"] for r in both)


def test_terms_of_tokens_equal_terms_of_ngrams(spark, monkeypatch):
    """Pairs are counted only where they can get in, and nothing is lost: words as frequent as the last one stay."""
    rows = [(["aa", "bb", "aa", "bb", "x"],), (["bb", "aa", "cc"],), ([],), (["cc", "dd", "ee", "ff"],), (["zz", None, "aa", "bb"],)]
    df = spark.createDataFrame(rows * 3, "tokens array<string>")
    for spaced in (df, df.unionByName(spark.createDataFrame([(["aa bb", "aa", "bb"],)], df.schema))):
        terms = spaced.withColumn("t", tfidf.ngrams(F.col("tokens")))
        for most, block in ((3, 1), (100, tfidf.BLOCK)):
            monkeypatch.setattr(tfidf, "BLOCK", block)
            model = tfidf.fit(spaced, "tokens", most, sizes=tfidf.SIZES)
            assert model == tfidf.fit(terms, "t", most)
            told = model.transform(model.transform(terms, "t", "x"), "tokens", "y", tfidf.SIZES).select("x", "y").collect()
            assert all(r["x"] == r["y"] for r in told)
        sums = {r["index"]: r["total"] for r in model.totals(spaced, "tokens", tfidf.SIZES).collect()}
        parts = tfidf.entries(model.transform(terms, "t"), []).groupBy("index").agg(F.sum("weight").alias("w")).collect()
        assert sums == pytest.approx({r["index"]: r["w"] for r in parts})


def test_rare_pairs_are_not_counted(spark):
    words = [f"w{i:03}" for i in range(60)]
    df = spark.createDataFrame([(["aa", "bb", w],) for w in words], "tokens array<string>")
    counted = tfidf._counted(df, "tokens", (1,))
    assert sorted(tfidf._frequent(counted, 2, 60)) == ["aa", "bb"]
    assert tfidf._frequent(counted, 70, 60) is None


def test_models_that_stand_still_are_not_scanned_again(spark, monkeypatch):
    from resona.operators import kmeans

    scanned, add_up = [], kmeans._add_up
    monkeypatch.setattr(kmeans, "_add_up", lambda found, models, size: scanned.append(len(models)) or add_up(found, models, size))
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 3), 1 + i % 2, 4)]) for i in range(300)]
    found = kmeans.points(K.dense_features(spark.createDataFrame(rows, "id int, v array<double>"), "v"), "id").localCheckpoint()
    models = kmeans.fit_all(found, [2, 3, 4], restarts=4, seed=1)
    assert scanned[0] == scanned[-1] == 12 and min(scanned) < 12
    for model in models.values():
        again = add_up(found, [model.centres], 4)[0]
        assert np.allclose(again["sums"] / again["weights"][:, None], model.centres)


def test_assignment_in_batches_equals_that_by_columns(spark):
    from resona.operators import kmeans

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 5)]) for i in range(200)]
    df = K.dense_features(spark.createDataFrame(rows, "id int, v array<double>"), "v")
    centres = rng.integers(0, 3, (4, 5)).astype(float)
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    both = K.kmeans_assign(df, listed).select("cluster", kmeans.nearest(F.col("features"), centres).alias("own")).collect()
    assert len(both) == 200 and all(r.cluster == r.own for r in both)
