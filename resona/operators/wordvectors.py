"""Word vectors trained on the texts themselves (skip-gram with negative sampling), and their mean per text.

The texts are dealt to parts of about PART_CHARS characters. A task trains the words of one part, from vectors that
depend on the word alone; a word's vector is the mean of those of the parts that have it. Words and vectors are tables,
so no vocabulary passes through the driver, and a task holds the words of its part however many there are in all. Words
of one part only, most of a large vocabulary, are added to their texts where they were trained and do not travel.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.functions.patterns import SPACES
from resona.session import cut_lineage

PART_CHARS = 24_000_000  # some four million words
WINDOW = 5
NOISE = 5  # words drawn against each word, by their frequency to the power of POWER
POWER = 0.75
RATE = 0.025  # of the first step; it falls in proportion to the words seen
STEP = 512  # words trained at once
MOST_MOVES = 16  # of a word in one step; more count as so many, for all are made from the same vectors
BLOCK = 250_000  # words whose vectors are added up at once, or those of one text if it has more


def dealt(df: DataFrame, text: str, parts: int) -> DataFrame:
    """`df` stored with `_row` and `_part`: at least `parts` parts, of about PART_CHARS each if there are more."""
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(parts, math.ceil(total / PART_CHARS))
    return rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(n)))


def _split(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The number of the text of each word, and the words, as `split_words` gives them; a null text has none."""
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.string()), ""), pattern=SPACES).combine_chunks()
    words = lists.flatten()
    kept = pc.not_equal(words, "")
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return text[kept.to_numpy(zero_copy_only=False)], words.filter(kept)


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, or -1."""
    encoded = words.dictionary_encode()
    place = pc.fill_null(pc.index_in(encoded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
    return place[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)


def part_words(rows: DataFrame, text: str) -> DataFrame:
    """(_part, word, n) of dealt rows; stored."""

    def count(key: tuple, texts: pa.Table) -> pa.Table:
        found = pc.value_counts(_split(texts[text])[1])
        part = pa.array(np.full(len(found), key[0].as_py(), np.int64))
        return pa.table({"_part": part, "word": found.field("values"), "n": found.field("counts")})

    return cut_lineage(rows.select("_part", text).groupBy("_part").applyInArrow(count, "_part long, word string, n long"))


def _sums(text: np.ndarray, place: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The sum of the vectors of each text's words, by blocks; places under 0 count nothing."""
    text, place = text[place >= 0], place[place >= 0]
    sums, first = np.zeros((n, vectors.shape[1])), 0
    while first < len(text):
        last = len(text) if first + BLOCK >= len(text) else int(np.searchsorted(text, text[first + BLOCK]))
        if last <= first:  # one text has more
            last = int(np.searchsorted(text, text[first], side="right"))
        start = np.flatnonzero(np.append(True, np.diff(text[first:last]) != 0))
        sums[text[first + start]] = np.add.reduceat(vectors[place[first:last]], start, axis=0, dtype=np.float64)
        first = last
    return sums


def _columns(vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {f"v{i}": np.ascontiguousarray(vectors[:, i], np.float32) for i in range(vectors.shape[1])}


def first_vectors(hashes: np.ndarray, size: int) -> np.ndarray:
    """Small vectors that depend on the hash of a word only."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) / size).astype(np.float32)


def _move(vectors: np.ndarray, places: np.ndarray, moves: np.ndarray, times: np.ndarray) -> None:
    """Add the moves to the vectors at their places. Each is the sum of so many `times`; of one place at most MOST_MOVES
    count, in equal shares of all."""
    kept = times > 0
    places, moves, times = places[kept], moves[kept], times[kept]
    if not len(places):
        return
    order = np.argsort(places, kind="stable")
    ranked = places[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    held = np.add.reduceat(times[order], start)
    total = np.add.reduceat(moves[order], start, axis=0)
    vectors[ranked[start]] += total * np.minimum(1, MOST_MOVES / held).astype(np.float32)[:, None]


def trained(text: np.ndarray, code: np.ndarray, counts: np.ndarray, vectors: np.ndarray, seed: list[int]) -> np.ndarray:
    """`vectors` after one pass over words in order, `text` the number of the text of each and `code` its row in `vectors`;
    `counts` has the frequency of each row. Every word predicts those around it, up to a distance drawn anew."""
    random, n = np.random.default_rng(seed), len(code)
    inner, outer = vectors.copy(), np.zeros_like(vectors)
    noise = np.cumsum(counts.astype(np.float64) ** POWER)
    ways = np.concatenate([np.arange(-WINDOW, 0), np.arange(1, WINDOW + 1)])
    target = np.zeros((1, 1, 1 + NOISE), np.float32)
    target[..., 0] = 1
    for first in range(0, n, STEP):
        at = np.arange(first, min(first + STEP, n))
        near = at[:, None] + ways
        inside = (near >= 0) & (near < n) & (np.abs(ways) <= random.integers(1, WINDOW + 1, len(at))[:, None])
        near = np.clip(near, 0, n - 1)
        inside &= text[near] == text[at][:, None]
        drawn = np.searchsorted(noise, random.random((len(at), NOISE)) * noise[-1], side="right")
        drawn = np.minimum(drawn, len(counts) - 1)
        wanted = np.concatenate([code[at][:, None], drawn], axis=1)
        counted = np.concatenate([np.ones((len(at), 1), bool), drawn != code[at][:, None]], axis=1)
        given = code[near]
        x, y = inner[given], outer[wanted]
        product = np.clip(x @ y.transpose(0, 2, 1), -30, 30)
        rate = np.float32(RATE * max(1 - first / n, 1e-4))
        error = (target - 1 / (1 + np.exp(-product))) * (inside[:, :, None] & counted[:, None, :]) * rate
        moves, times = np.zeros((len(at) + 2 * WINDOW, inner.shape[1]), np.float32), np.zeros(len(at) + 2 * WINDOW, np.int64)
        found = error @ y
        for i, way in enumerate(ways):  # each place is near to several words
            moves[WINDOW + way:WINDOW + way + len(at)] += found[:, i]
            times[WINDOW + way:WINDOW + way + len(at)] += inside[:, i]
        places = np.clip(np.arange(first - WINDOW, first + len(at) + WINDOW), 0, n - 1)
        _move(inner, code[places], moves, times)
        alone = ~inside.any(axis=1)
        counted[alone] = False
        _move(outer, wanted.ravel(), (error.transpose(0, 2, 1) @ x).reshape(-1, inner.shape[1]), counted.ravel())
    return inner


def fitted(rows: DataFrame, met: DataFrame, text: str, size: int, min_count: int, seed: int) -> DataFrame:
    """(word, _row, v0, v1, ...): the vector of each word of several parts, and by row the sum of those of the row's other
    words, of words that occur at least `min_count` times; stored. `met` are the `part_words` of the dealt rows."""
    vocabulary = met.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).where(F.col("n") >= min_count)
    given = met.select("_part", "word").join(vocabulary, "word").withColumn("h", F.xxhash64("word"))

    def train(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        texts, known = texts.sort_by("_row"), known.sort_by("word")
        listed, shared = known["word"].combine_chunks(), known["parts"].to_numpy() > 1
        vectors = first_vectors(known["h"].to_numpy(), size)
        of, words = _split(texts[text])
        place = _places(words, listed)
        if (place >= 0).any():
            vectors = trained(of[place >= 0], place[place >= 0], known["n"].to_numpy(), vectors, [seed, key[0].as_py()])
        here = np.where((place >= 0) & ~shared[place], place, -1) if len(listed) else place
        sums = _sums(of, here, vectors, len(texts))
        some = np.unique(of[here >= 0])
        return pa.table({
            "word": pa.concat_arrays([listed.filter(pa.array(shared)), pa.nulls(len(some), pa.string())]),
            "_row": pa.concat_arrays([pa.nulls(int(shared.sum()), pa.int64()), texts["_row"].combine_chunks().take(pa.array(some))]),
        } | _columns(np.concatenate([vectors[shared], sums[some]])))

    names = [f"v{i}" for i in range(size)]
    schema = "word string, _row long, " + ", ".join(f"{c} float" for c in names)
    found = rows.select("_part", "_row", text).groupBy("_part").cogroup(given.groupBy("_part")).applyInArrow(train, schema)
    return cut_lineage(found.groupBy("word", "_row").agg(*[F.avg(c).cast("float").alias(c) for c in names]))


def add_means(rows: DataFrame, met: DataFrame, model: DataFrame, text: str, size: int, output: str) -> DataFrame:
    """Dealt rows without `_row` and `_part`, with the mean vector of their words as an array (zeros for none); words
    without a vector count as zeros. `model` is that of `fitted`."""
    names = [f"v{i}" for i in range(size)]
    given = met.select("_part", "word").join(model.where(F.col("word").isNotNull()).drop("_row"), "word")

    def add_up(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        vectors = np.stack([known[c].to_numpy() for c in names], axis=1)
        of, words = _split(texts[text])
        sums = _sums(of, _places(words, known["word"].combine_chunks()), vectors, len(texts))
        return pa.table({"_row": texts["_row"], "_n": np.bincount(of, minlength=len(texts))} | _columns(sums))

    schema = "_row long, _n long, " + ", ".join(f"{c} float" for c in names)
    summed = rows.select("_part", "_row", text).groupBy("_part").cogroup(given.groupBy("_part")).applyInArrow(add_up, schema)
    others = model.where(F.col("_row").isNotNull()).drop("word").withColumn("_n", F.lit(0).cast("long"))
    totals = summed.unionByName(others).groupBy("_row").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in names])
    mean = F.array(*[F.col(c) / F.greatest(F.col("_n"), F.lit(1)) for c in names])
    return rows.drop("_part").join(totals.select("_row", mean.alias(output)), "_row").drop("_row")


def embedded(df: DataFrame, text: str, output: str, size: int, parts: int, min_count: int, seed: int = 42) -> DataFrame:
    """`df` with the mean vector of each text's words, as an array of doubles."""
    rows = dealt(df, text, parts)
    met = part_words(rows, text)
    return add_means(rows, met, fitted(rows, met, text, size, min_count, seed), text, size, output)
