import numpy as np

from resona.operators import relevance, wordvectors

KINDS = ["lipstick gloss mascara blush", "shampoo curl braid scalp", "serum toner cream acne"]


def texts():
    random, found = np.random.default_rng(1), []
    for i in range(1200):
        found.append(" ".join(random.choice(KINDS[i % 3].split(), 12)))
    return found


def embedded(spark, listed, parts=2, min_count=1):
    """By text, its vector; equal texts have one."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(listed)], "id long, t string")
    rows = wordvectors.embedded(df, "t", "v", 16, parts, min_count).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(listed)))
    found = {}
    for r in rows:
        assert np.allclose(found.setdefault(r["t"], np.array(r["v"])), r["v"], atol=1e-6)
    return found


def test_words_of_the_same_texts_are_alike(spark):
    found = embedded(spark, texts() + " ".join(KINDS).split())
    unit = {w: v / np.linalg.norm(v) for w, v in found.items() if " " not in w}
    kind = {w: i for i, k in enumerate(KINDS) for w in k.split()}
    inside = [unit[a] @ unit[b] for a in kind for b in kind if a < b and kind[a] == kind[b]]
    across = [unit[a] @ unit[b] for a in kind for b in kind if a < b and kind[a] != kind[b]]
    assert min(inside) > max(across)


def test_the_vocabulary_is_trained_in_parts(spark, monkeypatch):
    """No part has all words; a text has the mean of its words' vectors, whether they are of one part or of several."""
    monkeypatch.setattr(wordvectors, "PART_CHARS", 200)
    monkeypatch.setattr(wordvectors, "BLOCK", 5)
    many = [f"w{i} w{i + 1} w{i + 2} common common" for i in range(100)]
    words = sorted({w for t in many for w in t.split()})
    df = spark.createDataFrame([(t,) for t in many + words + ["alone alone"]], "t string")
    rows = wordvectors.dealt(df, "t", 2)
    met = wordvectors.part_words(rows, "t").groupBy("_part").count().collect()
    assert len(met) > 5 and max(r["count"] for r in met) < len(words) / 2
    found = embedded(spark, many + words + ["alone alone"])
    for t in many:
        assert np.allclose(found[t], np.mean([found[w] for w in t.split()], axis=0), atol=1e-6)
    assert all(v.any() for v in found.values())


def test_words_without_a_vector_count_as_zeros(spark):
    found = embedded(spark, ["a a b", "a", "b a", "", " ", None, "a\u00a0x", "a  a"], min_count=3)
    a = found["a"]
    assert a.any() and not found[""].any() and not found[" "].any() and not found[None].any()
    for t, share in {"a a b": 2 / 3, "b a": 1 / 2, "a\u00a0x": 1 / 2, "a  a": 1}.items():
        assert np.allclose(found[t], share * a, atol=1e-6)


def test_dense_embedding_is_the_same_in_every_run(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts()[:60], "", None])], "id long, clean string")
    runs = [{r["id"]: r["v"] for r in relevance.embed_dense(df, "clean", "v", size=8).collect()} for _ in range(2)]
    assert runs[0].keys() == runs[1].keys() == set(range(62))
    assert all(np.allclose(runs[0][i].toArray(), runs[1][i].toArray(), atol=1e-7) for i in range(62))
    assert not runs[0][60].toArray().any() and not runs[0][61].toArray().any()
