import random

import numpy as np
import xxhash

from resona.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(points, reach):
    """Smallest index reachable, per point."""
    label = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(points):
            low = min(label[j] for j, b in enumerate(points) if (a ^ b).bit_count() <= reach)
            if low < label[i]:
                label[i], changed = low, True
    return label


def clustered(n, seed):
    """Points in groups a few bits apart, so that links chain."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 10)]
    return list({rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(n)})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_brute_force():
    for text in (None, "", " \t", "One", "one TWO", "a b c", "É é b  c d\x0be", "x y " * 3000, "Ünï 漢字 a b c d"):
        assert simhash.fingerprint_of(text) % (1 << 64) == brute_fingerprint(text)


def test_links_of_many_shards_equal_brute_force(spark):
    points = clustered(900, 5)
    frame = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    links = simhash.hamming_links(frame, 2, shard_size=40).collect()
    parent = {signed(p): signed(p) for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[find(r.a)] = find(r.b)
    expected = brute_classes(points, 2)
    groups = {}
    for p, label in zip(points, expected):
        groups.setdefault(find(signed(p)), set()).add(label)
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(expected))


def test_tight_cluster_without_good_cuts():
    rng = np.random.default_rng(2)
    points = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (1500, 3)).astype(np.uint64), axis=1))
    a, b = simhash.links_within(points, 2)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert set(a.tolist()) | set(b.tolist()) == set(points[near.sum(axis=1) > 1].tolist())
    assert (np.bitwise_count(points[:, None] ^ points[None, :]).max()) <= 6


def test_brute_force_on_documents(spark, docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", "one", " ", "two words"] + [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(40)]
    texts += [t + " end" for t in texts[10:20]] + texts[20:30]
    ids = [3 * i for i in range(len(texts))]
    points = [brute_fingerprint(t) for t in texts]
    label = brute_classes(points, 2)
    rows = simhash.near_duplicates(docs(*zip(ids, texts)).repartition(4)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (i, f"{p:016x}", ids[x]) for i, p, x in zip(ids, points, label)}
    kept = simhash.deduplicated(docs(*zip(ids, texts), (0, None)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({ids[x] for x in label})
    assert "component_id" not in kept.columns and "key" in kept.columns


def test_null_ids_repeated_rows_and_empty_table(spark, docs):
    frame = docs((None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words here now"))
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(frame).collect())
    assert found == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert simhash.deduplicated(frame).count() == 2
    assert simhash.near_duplicates(docs((1, "x")).limit(0)).collect() == []
