import random

import numpy as np
import pytest

from resona.llm import passages as p


def brute_windows(hashes, least):
    """Maximal (l, r) around each minimum, from all subsequences."""
    found = set()
    for i in range(len(hashes)):
        for j in range(i + least - 1, len(hashes)):
            c = i + int(np.argmin(hashes[i:j + 1]))
            left = c
            while left > 0 and hashes[left - 1] > hashes[c]:
                left -= 1
            right = c
            while right + 1 < len(hashes) and hashes[right + 1] >= hashes[c]:
                right += 1
            found.add((left, c, right))
    return found


def text(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def marked(rows):
    return {r.doc_id: (r.n_words, r.n_repeated, list(r.sources)) for r in rows}


def test_compact_windows_cover_all_subsequences():
    rng = np.random.default_rng(1)
    for n, least in ((1, 1), (5, 6), (40, 7), (60, 1)):
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        assert set(p.windows(hashes, least)) == brute_windows(hashes, least)


def test_a_long_text_of_one_word_has_one_chain_per_hash():
    own = np.zeros(20_000, np.uint64)
    assert p.chains(p.windows(own, 46), own).tolist() == [[0, 0, 19_954, 19_999]]


def test_interval_join_equals_brute_force():
    rng = np.random.default_rng(2)
    rows = []
    for at in range(3):
        for fn in range(3):
            own = rng.integers(1, 2**62, 150).astype(np.uint64)
            own[20:90:7] = own[5]
            rows += [(at, fn, int(own[c]), low, c, d, r) for low, c, d, r in p.chains(p.windows(own, 20), own).tolist()]
    assert any(x[5] > x[4] for x in rows)
    names = ["at", "fn", "sig", "l", "c", "d", "r"]
    expected = sorted(
        (a[0], max(a[3], b[3]), min(a[6], b[6])) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and max(a[3], b[3]) <= min(a[5], b[5])
        and max(a[4], b[4]) <= min(a[6], b[6]) and min(a[6], b[6]) - max(a[3], b[3]) + 1 >= 20)
    place, _, first, last, _ = p.joined_windows({n: np.array(x) for n, x in zip(names, zip(*rows))}, 20)
    assert sorted((rows[i][0], f, e) for i, f, e in zip(place, first.tolist(), last.tolist())) == expected


def test_documents_are_not_cut_in_two(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(p, "HELD_ROWS", 4)
    keys = [1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 4, 5, 5]
    batches = [pd.DataFrame({"key": keys[i:i + 3]}) for i in range(0, len(keys), 3)]
    found = [x["key"].tolist() for x in p.whole_documents(iter(batches))]
    assert sum(found, []) == keys and all(a[-1] != b[0] for a, b in zip(found, found[1:]))


def test_planted_passages(spark, docs):
    rng = random.Random(3)
    passage, near, common = text(rng, 60), text(rng, 120), text(rng, 20)
    changed = list(near)
    changed[40] = "other"
    made = [text(rng, 200) + passage + text(rng, 80), text(rng, 30) + [w.upper() for w in passage] + text(rng, 100)]
    made += [passage, text(rng, 300) + near, changed + text(rng, 90)]
    made += [text(rng, 60) + common + text(rng, 60) for _ in range(20)]  # a line that is too short to count
    made += [text(rng, 49), text(rng, 3000), text(rng, 10) * 30]
    rows = [(i, " ".join(w)) for i, w in enumerate(made)] + [(100, None), (101, ""), (102, "few words")]
    found = marked(p.passages(docs(*rows).repartition(5)).collect())
    assert len(found) == len(rows)
    assert found[1] == (190, 60, [0]) and found[2] == (60, 60, [0])
    assert found[4][2] == [3] and found[4][1] >= 115
    assert found[27][2] == [27] and found[27][1] >= 250  # repeats itself
    clean = {i: x for i, x in found.items() if i not in (1, 2, 4, 27)}
    assert all(n == 0 and not s for _, n, s in clean.values())
    cut = {r.doc_id: r for r in p.without_repeats(docs(*rows)).collect()}
    assert set(cut) == set(found) - {2}
    assert cut[1].text.split() == made[1][:30] + made[1][90:] and cut[1].n_chars == len(cut[1].text)
    assert cut[0].text == rows[0][1] and cut[100].text is None and cut[101].text == "" and cut[0].key == "x"


def test_a_group_of_many_copies_stays_linear(spark, docs):
    rng = random.Random(4)
    passage = " ".join(text(rng, 70))
    rows = [(i, " ".join(text(rng, 20)) + " " + passage) for i in range(150)]
    spans = p.repeated(docs(*rows)).collect()
    assert sorted(s.doc_id for s in spans) == list(range(1, 150)) and {s.of for s in spans} == {0}


def lead_holds_all_minima(words, part):
    """Whether each hash of the shingles of `words` is least inside the first `part` words."""
    tokens = p.shingles(" ".join(words))
    seeds = p.mixed(np.arange(1, p.HASHES + 1, dtype=np.uint64))
    return all(p.mixed(tokens ^ s).argmin() <= part - p.SHINGLE for s in seeds)


def test_a_lead_that_fails_does_not_hide_the_partners_behind_it(spark, docs):
    rng, passages = random.Random(6), []
    while len(passages) < 3:
        words = text(rng, 50)
        if lead_holds_all_minima(words, 40):
            passages.append(words)
    rows = []
    for i, words in enumerate(passages):
        rows += [(100 * i, " ".join(words[:40] + text(rng, 60)))]  # has 40 of the 50 words
        rows += [(100 * i + 1 + j, " ".join(words + text(rng, 60))) for j in range(2 if i else 12)]
        rows += [(100 * i + 50 + j, " ".join(words[:40] + text(rng, 60))) for j in range(12)]
    found = marked(p.passages(docs(*rows)).collect())
    expected = {100 * i + 2 + j: (110, 50, [100 * i + 1]) for i in range(3) for j in range(1 if i else 11)}
    assert {k: v for k, v in found.items() if v[1]} == expected


def similarity(a, b):
    a, b = set(p.shingles(" ".join(a)).tolist()), set(p.shingles(" ".join(b)).tolist())
    return len(a & b) / len(a | b)


def test_recall_of_exact_and_near_passages(spark, docs):
    """Planted in documents of their own words: every exact repeat is found, also cut short at either end of the text and
    behind leads that hold a part of it; of near copies at similarity 0.8 or more at least nine in ten."""
    rng, rows, exact, near = random.Random(12), [], [], []
    for i in range(60):
        words, at = text(rng, rng.randint(50, 140)), 1000 * i
        rows.append((at, " ".join(text(rng, rng.randint(0, 40)) + words + text(rng, rng.randint(0, 40)))))
        rows.append((at + 1, " ".join(text(rng, rng.randint(0, 40)) + words + text(rng, rng.randint(0, 40)))))
        exact.append((at + 1, len(words)))
    for i in range(60, 260):
        words, at = text(rng, rng.randint(60, 160)), 1000 * i
        while True:
            other = list(words)
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = f"new{rng.randrange(10**6)}"
            if similarity(words, other) >= 0.8:
                break
        rows.append((at, " ".join(text(rng, 30) + words + text(rng, 30))))
        rows.append((at + 1, " ".join(text(rng, 30) + other + text(rng, 30))))
        near.append(at + 1)
    found = marked(p.passages(docs(*rows)).collect())
    assert all(found[doc][1] == n and found[doc][2] == [doc - 1] for doc, n in exact)
    caught = [doc for doc in near if found[doc][1] >= 50 and found[doc][2] == [doc - 1]]
    assert len(caught) >= 0.9 * len(near), len(caught) / len(near)
    print("near copies found:", len(caught), "of", len(near))
    assert all(not n for doc, (_, n, _) in found.items() if doc % 1000 == 0)


def test_stretches_find_a_passage_whose_parts_stand_elsewhere_too():
    rng = random.Random(8)
    line, rest, edited = text(rng, 10), text(rng, 45), text(rng, 120)

    def found(own, others, same=False):
        return p.stretches(*(p.shingles(" ".join(w)) for w in (own, others)), 0, 0, same, 46, 0.8)

    lead = line + text(rng, 30) + line + rest + text(rng, 20)
    assert found(text(rng, 7) + line + rest, lead) == [(7, 57, 40, 90)]
    truncated = (line + rest)[:30] + text(rng, 5) + line + rest
    assert found((line + rest)[:50], truncated) == [(0, 45, 35, 80)]
    other = list(edited)
    other[60] = "other"
    other[61:71] = edited[61:71] = line  # a frequent line behind the edit
    assert found(other, line + text(rng, 9) + edited) == [(0, 115, 19, 134)]
    assert found(["w"] * 500, ["w"] * 500, same=True) == [(1, 495, 0, 494)]


def test_longest_runs_equal_brute_force():
    rng = np.random.default_rng(9)
    for n, values, same in [(30, 3, False), (40, 6, True), (25, 200, False), (30, 2, True)] * 10:
        own, others = rng.integers(0, values, n), rng.integers(0, values, n)
        others = own if same else others
        pairs = {(i, j) for i in range(n) for j in range(n) if own[i] == others[j] and (not same or j < i)}
        longest = {}
        for i, j in sorted(pairs):
            size = 1
            while (i + size, j + size) in pairs:
                size += 1
            longest[i] = max(longest.get(i, 0), size)
        ends = {i: i + s - 1 for i, s in longest.items()}
        expected = [(i, e) for i, e in ends.items() if not any(k < i and f >= e for k, f in ends.items())]
        runs = p.longest_runs(own, others, 0, same)
        assert [r[:2] for r in runs] == sorted(expected)
        assert all((own[a:b + 1] == others[c:d + 1]).all() and d - c == b - a for a, b, c, d in runs)


def test_all_windows_of_the_lead_are_compared(spark, docs):
    rng = random.Random(10)
    part, whole = text(rng, 49), text(rng, 11)
    lead = part + text(rng, 500) + part + whole
    found = marked(p.passages(docs((0, " ".join(lead)), (1, " ".join(text(rng, 30) + part + whole)))).collect())
    assert found[1] == (90, 60, [0])


def test_null_ids_repeated_rows_and_empty_table(spark, docs):
    rng = random.Random(5)
    passage = " ".join(text(rng, 55))
    frame = docs((2**60 + 1, passage), (2**60 + 1, passage), (None, passage + " more"), (2**60 + 3, "x " + passage))
    rows = p.passages(frame).collect()
    found = sorted((r.doc_id or 0, r.n_repeated, r.sources) for r in rows)
    assert found == [(0, 0, []), (2**60 + 1, 55, []), (2**60 + 1, 55, []), (2**60 + 3, 55, [])]
    assert p.without_repeats(frame).count() == 2
    assert p.passages(frame.limit(0)).collect() == []


def test_words_are_cut_with_their_space():
    assert p.without("a b  c\nd e", [(1, 2)]) == "a d e"
    assert p.without(" a b", [(0, 1)]) == "" and p.without("a b c", [(1, 2)]) == "a"


def test_what_is_found_behind_a_failed_lead_does_not_depend_on_the_size_of_its_group(spark, docs):
    """Near copies that differ next to what they share with the lead; many documents that share only that."""
    rng, sizes, rows = random.Random(14), (0, 12), []
    seeds = p.mixed(np.arange(1, p.HASHES + 1, dtype=np.uint64))

    def holds_minima(words):
        tokens = p.shingles(" ".join(words))
        return all(10 <= p.mixed(tokens ^ s).argmin() <= 35 for s in seeds)

    pairs = []
    while len(pairs) < 8:
        words = text(rng, 60)
        other = words[:40] + text(rng, 1) + words[41:]
        if holds_minima(words) and holds_minima(other):
            pairs.append((words, other, text(rng, 60), text(rng, 60), text(rng, 60)))
    for side, size in enumerate(sizes):
        for i, (words, other, *tails) in enumerate(pairs):
            made = [words[:40] + tails[0], words + tails[1], other + tails[2]]
            made += [words[:40] + text(rng, 60) for _ in range(size)]
            rows += [(10_000 * side + 100 * i + j, w) for j, w in enumerate(made)]
    results = []
    for side in range(len(sizes)):
        own = [(i % 10_000, " ".join(w)) for i, w in rows if i // 10_000 == side]
        found = marked(p.passages(docs(*own)).collect())
        results.append({i: x for i, x in found.items() if i % 100 < 3})
    assert results[0] == results[1]
    assert sum(n > 0 for _, n, _ in results[0].values()) >= 4


def test_windows_of_all_equal_those_of_each():
    rng = np.random.default_rng(15)
    texts = [rng.integers(1, top, n).astype(np.uint64) for n, top in (
        (0, 9), (3, 9), (200, 2**62), (7, 2**62), (300, 12), (8, 3), (40, 2), (0, 9), (90, 2**62))]
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    for least in (1, 7, 8, 46):
        expected = sorted((int(a) + l, int(a) + c, int(a) + r) for a, t in zip(starts, texts) for l, c, r in p.windows(t, least))
        assert sorted(map(tuple, p.windows_of_all(np.concatenate(texts), starts, least).tolist())) == expected


def test_shingles_of_several_texts():
    texts = ["a b c d e f", None, "", "x", "A  b\tC d e", "p q r s t u v w"]
    tokens, starts = p.shingled(texts)
    assert [tokens[a:b].tolist() for a, b in zip(starts, starts[1:])] == [p.shingles(t).tolist() for t in texts]


@pytest.mark.parametrize("few", [0, 10_000])
def test_only_groups_that_go_on_are_stored(spark, monkeypatch, few):
    """Groups of one document, most of them, were stored and shuffled with those of several."""
    monkeypatch.setattr(p, "FEW_GROUPS", few)
    names = [c.split()[0] for c in p.GROUPED.split(", ")]
    rows = spark.createDataFrame([
        (True, 1, 1, 7, 0, 50, False, [3, 4]), (True, 2, 2, 7, 0, 50, False, [4, 5]), (True, 3, 3, 7, 0, 50, True, [6]),
        (True, 4, 4, 8, 0, 50, True, [3]), (True, 5, 5, 9, 0, 50, False, []), (True, 6, 6, 9, 0, 50, False, []),
    ], p.GROUPED + ", beside array<int>")
    found = p.regrouped(rows)
    assert found.columns == names
    kept = found.collect()
    # A shingle that two documents have; one document with several places in a pair of others; not a pair of its own.
    assert sorted(r.key for r in kept) == [1, 2, 3]
    assert len({r.pair for r in kept if r.key < 3}) == 1
