import hashlib

from resona.llm import fingerprints as fp


def expected(texts):
    """By position, with the next text of the list, and the first after the last."""
    for i, text in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(text) // 2
        yield text, text[:len(text) - half] + following[:half], following


def check(rows, texts, ids):
    by_id = {r.doc_id: r for r in rows}
    for i, (text, changed, following) in zip(ids, expected(texts)):
        row, own = by_id[i], fp.Fingerprint.of(text)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == own.hex()
        assert row.edited_fingerprint == fp.Fingerprint.of(changed).hex()
        assert row.near_edited == own.likeness(fp.Fingerprint.of(changed))
        assert row.near_next == own.likeness(fp.Fingerprint.of(following))


def test_brute_force(spark, docs):
    texts = ["", "a", "é漢🇫🇷 b c\nd e f", "one two three four\nfive six", "x" * 90_000, "tie", "tie", "\n\n"]
    texts += [f"document {i} has\nits own {i * 7} words\nand lines" for i in range(40)]
    ids = [7 * i - 50 for i in range(len(texts))]
    frame = docs(*zip(ids, [t or None for t in texts])).repartition(5)
    check(fp.fingerprint(frame).collect(), texts, ids)


def test_repeated_rows_null_ids_and_one_document(spark, docs):
    rows = fp.fingerprint(docs((1, "a b"), (1, "a b"), (2, "c d"), (None, "e f"))).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 1, 2] and len(rows) == 4
    check([r for r in rows if r.doc_id is not None or True], ["e f", "a b", "c d"], [None, 1, 2])
    check(fp.fingerprint(docs((2**60 + 1, "alone"))).collect(), ["alone"], [2**60 + 1])
    assert fp.fingerprint(docs((1, "x")).limit(0)).collect() == []


def test_hash_is_order_free_and_incremental():
    of = fp.Fingerprint.of
    assert of("a b c\nd e f") == of("d e f\na b c") != of("a b c\nd e g")
    assert of("a b c") + of("d e f") - of("a b c") == of("d e f")
    assert of("a b c") + of("d e f") == of("d e f\na b c")
    assert of(None) == of("")


def test_likeness_follows_the_common_part():
    words = [f"w{i}" for i in range(2000)]
    whole = fp.Fingerprint.of(" ".join(words))
    assert whole.likeness(whole) == 1
    for share in (0.0, 0.25, 0.5, 0.75):
        kept = words[:int(2000 * share)] + [f"v{i}" for i in range(2000 - int(2000 * share))]
        assert abs(whole.likeness(fp.Fingerprint.of(" ".join(kept))) - share) < 0.3


def test_long_repetitive_texts_without_common_words_are_not_alike():
    of = fp.Fingerprint.of
    assert of("one " * 20_000).likeness(of("two " * 20_000)) < 0.3
    lines = [" ".join(f"{c}{i}" for i in range(100)) for c in "ab"]
    assert of("\n".join([lines[0]] * 3000)).likeness(of("\n".join([lines[1]] * 3000))) < 0.3
