import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from resona.llm import codes


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20).flatmap(lambda d: st.tuples(
    arrays(np.int64, st.tuples(st.integers(1, 30), st.just(d)), elements=st.integers(-2000, 2000)),
    arrays(np.int64, st.tuples(st.integers(1, 40), st.just(d)), elements=st.integers(-3, 3) | st.integers(-2000, 2000)),
)))
def test_nearest_equals_brute_force(both):
    parts, entries = both
    found, distances = codes.nearest(parts, entries)
    for x, entry, distance in zip(parts, found, distances):
        all_of = ((entries - x) ** 2).sum(axis=1)
        assert distance == all_of.min() and entry == all_of.argmin()


def test_transform_is_in_sequency_order_and_keeps_distances():
    for size in (1, 2, 4, 16, 32):
        order = codes.sequency(size)
        rows = codes.transformed(np.eye(size, dtype=np.int64), order).T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(size))
    x = np.arange(12).reshape(1, 12) ** 2
    assert (codes.transformed(x, codes.sequency(16)) ** 2).sum() == 16 * (x ** 2).sum()


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error), codebooks; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    size = width // parts
    ints = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[cut(ints[i], p) for i in order[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = defaultdict(list)
            for v in ints:
                members[assign(v, p)[1]].append(cut(v, p))
            for k, own in members.items():
                new[p][k] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    out, totals = [], defaultdict(int)
    for (vec_id, _, label), v in zip(kept, ints):
        found = [assign(v, p) for p in range(parts)]
        out.append([vec_id, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
        totals[label] += out[-1][2]
    return [(i, c, e, totals[label]) for i, c, e, label in out], books


def same(spark, rows, **sizes):
    frame = spark.createDataFrame(
        [(*r, "x", 1, "c") for r in rows],
        "vec_id long, embedding array<float>, label int, code string, id int, vector string")
    got = codes.compress(frame, **sizes).collect()
    expected, books = brute(rows, **sizes)
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, expected))
    assert {r["codebooks_sha256"] for r in got} == ({codes.digest([np.array(b) for b in books])} if got else set())


def test_small_tables_equal_brute_force(spark):
    import random

    random.seed(5)
    floats = lambda n: [float(np.float32(random.gauss(0, 1))) for _ in range(n)]
    rows = [(i, floats(16), i % 3 or None) for i in range(60)]
    same(spark, rows, entries=8)
    odd = rows[:20] + rows[:5] + [
        (None, floats(16), 1), (None, floats(16), None), (3, floats(16), 2), (100, None, 1), (101, [None] * 16, 1),
        (102, [1.0] * 15 + [float("nan")], 1), (103, [float("-inf")] + [0.0] * 15, 2), (-1, floats(13), 1),
        (-2, [], 2), (500, [0.5] * 16, 9),
    ]
    same(spark, odd, entries=8)
    same(spark, odd, entries=256)
    same(spark, [(1, [], 1), (2, [], 1)])
    same(spark, [(1, None, 1)])
    same(spark, [])


def test_many_copies_of_one_vector(spark):
    same(spark, [(i, [0.25] * 8, 1) for i in range(300)] + [(i, [float(i)] * 8, 2) for i in range(5)], entries=4, parts=2)


def test_components_beyond_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        codes.compress(frame)


def test_encode_keeps_other_columns(spark):
    rows = [(1, [1.0, 2.0], "a", "b", "c"), (2, None, "a", "b", "c")]
    frame = spark.createDataFrame(rows, "i long, embedding array<float>, coded string, ERROR string, vector string")
    got = codes.encode(frame, [np.array([[1024], [0]]), np.array([[0], [2000]])])
    assert got.columns == ["i", "embedding", "coded", "vector", "code", "error"]
    assert [tuple(r)[2:] for r in got.collect()] == [("a", "c", "0001", 48 ** 2)]


def test_query_equals_sql(spark, base):
    got = codes.op13(spark, base)
    relation = duckdb.connect().execute(codes.SQL.replace("FROM embeddings", f"FROM '{base}/embeddings.parquet'"))
    names = [c[0] for c in relation.description]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(relation.fetchall())
