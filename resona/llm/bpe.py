"""Byte-level BPE over whole texts, as Spark higher-order functions.

A word is a byte array, as token ids of its single bytes. A fold over it joins, as long as there is one,
the neighbouring pair whose joined piece has the lowest rank; the state is the array of ids and the array
of what each neighbouring pair would become. What two ids become is looked up in one literal: the ranks
as a sparse matrix, each left id's row shifted so that the rows interlock in one array without clashes.
Such a lookup takes the same few steps for any number of ranks, where a map literal is searched key by
key. Decoding looks up the bytes of each id in an array literal and joins them.

The fold in Spark runs once for each of the words that are most frequent in a sample of the texts. A step of it costs about 10 microseconds,
so the many rare words are folded in the task that meets them, many words at a time as one array, by the
same steps over the same literal.
"""

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, read, short_plan_texts
from resona.session import cut_lineage

KNOWN_WORDS = 50_000  # most frequent distinct words: encoded once in Spark, looked up by all tasks
SAMPLE = 16  # one of so many texts, by a hash, is counted to find them
LONG_WORD = 128  # bytes; longer words are merged through a heap
HELD_WORDS = 200_000  # rare words whose ids a task keeps before it begins anew
HELD_COUNTS = 200_000  # distinct words a task counts before it passes them on
SHIFT = 1 << 20  # more than any id: entries of the literal are left id * SHIFT + joined id


NO_ENTRY = (1 << 62) - 1


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def pair_rows(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, entries): ids a and b become x if entries[starts[a] + b] is a * SHIFT + x, else they don't
    join. Wider rows are placed first, each where it hits free places only. The first number that is no
    id has a row outside, so it joins with nothing."""
    ranks = load_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    ids, tries = max(ranks.values()) + 1, np.arange(256)
    starts, entries = np.zeros(ids, np.int64), np.full(8 * ids, NO_ENTRY, np.int64)
    low = 0  # rows of about the same width go on where the last one was placed
    size = 1 << 30
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        at, become = np.array(row).T
        if 2 * len(row) <= size:
            low, size = 0, len(row)
        while True:
            if low + ids + len(tries) > len(entries):
                entries = np.append(entries, np.full(len(entries), NO_ENTRY, np.int64))
            free = (entries[low + tries[:, None] + at[None, :]] == NO_ENTRY).all(axis=1)
            if free.any():
                break
            low += len(tries)
        low += int(np.argmax(free))
        starts[left] = low
        entries[low + at] = left * SHIFT + become
    entries = entries[:np.flatnonzero(entries != NO_ENTRY)[-1] + 2]  # ends with a free place
    return np.append(starts, len(entries) - 1), entries


def literal(values, kind: str) -> Column:
    """A constant column of a nested value; Spark parses it once, when it plans."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def pair_table(path: str) -> Column:
    """The literal that `joined` looks pairs up in; free places are null."""
    starts, entries = pair_rows(path)
    return F.struct(
        literal(starts.tolist(), "array<int>").alias("starts"),
        literal([None if x == NO_ENTRY else x for x in entries.tolist()], "array<bigint>").alias("entries"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(table: Column, left: Column, right: Column) -> Column:
    """The id that two neighbouring ids become; SHIFT or more, or null, if they don't join."""
    found = F.get(table["entries"], F.get(table["starts"], left) + right)
    return found.bitwiseXOR(F.shiftleft(left.cast("long"), SHIFT.bit_length() - 1))


def merged(ids: Column, table: Column) -> Column:
    """The ids after all merges: lowest rank first, the leftmost of equal ones. `ids` has a number that is
    no id in front and behind, so that every pair has neighbours."""
    def step(state: Column, _: Column) -> Column:
        parts, become = state["parts"], state["become"]

        def merge(at: Column) -> Column:
            new, rest = F.get(become, at - 1).cast("int"), F.size(parts)
            return F.when(at > 0, F.struct(
                F.concat(F.slice(parts, 1, at - 1), F.array(new), F.slice(parts, at + 2, rest)).alias("parts"),
                F.concat(
                    F.slice(become, 1, at - 2),
                    F.array(joined(table, F.get(parts, at - 2), new), joined(table, new, F.get(parts, at + 1))),
                    F.slice(become, at + 2, rest),
                ).alias("become"),
            )).otherwise(state)

        def found(lowest: Column) -> Column:
            return F.when(lowest < SHIFT, F.array_position(become, lowest).cast("int")).otherwise(0)

        return _let(_let(F.array_min(become), found), merge)

    pairs = F.transform(F.slice(ids, 2, F.size(ids)), lambda x, i: joined(table, F.get(ids, i), x))
    start = F.struct(ids.alias("parts"), pairs.alias("become"))
    return F.aggregate(F.slice(ids, 4, F.size(ids)), start, step, lambda s: F.slice(s["parts"], 2, F.size(s["parts"]) - 2))


def byte_ids(ranks: dict[bytes, int]) -> list[int]:
    return [ranks[bytes([i])] for i in range(256)]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) for the column `word` of distinct byte arrays, by the fold in Spark."""
    ranks = load_ranks(path)
    single, outside = literal(byte_ids(ranks), "array<int>"), F.array(F.lit(max(ranks.values()) + 1))

    def run(tables: Column) -> Column:
        size = F.length("word")
        start = F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.get(tables["single"], F.conv(F.hex(F.substring("word", i, 1)), 16, 10).cast("int")),
        )
        return F.when(size == 0, F.array().cast("array<int>")).otherwise(
            merged(F.concat(outside, start, outside), tables["pairs"]))

    tables = F.struct(single.alias("single"), pair_table(path).alias("pairs"))
    return words.select("word", _let(tables, run).alias("ids"))


def fold_words(words: list[bytes], ranks: dict[bytes, int], pairs: tuple) -> list[np.ndarray]:
    """The ids of each word that is not itself a token: the same fold over many words at once, words of
    like length together."""
    starts, entries = pairs
    single, outside = np.array(byte_ids(ranks)), len(starts) - 1
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)

    def become(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return entries[np.minimum(starts[left] + right, len(entries) - 1)] ^ (left * SHIFT)

    order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
    for at in range(0, len(order), 4096):
        own = order[at:at + 4096]
        if len(words[own[-1]]) > LONG_WORD:
            short = [i for i in own if len(words[i]) <= LONG_WORD]
            for i in own[len(short):]:
                found[i] = merge_long(single[np.frombuffer(words[i], np.uint8)], become)
            own = short
            if not own:
                continue
        width = len(words[own[-1]])
        size = np.array([len(words[i]) for i in own])
        parts = np.full((len(own), width + 2), outside)
        parts[:, 1:-1][np.arange(width) < size[:, None]] = single[
            np.frombuffer(b"".join(words[i] for i in own), np.uint8)]
        rows, joins = np.array(own), become(parts[:, :-1], parts[:, 1:])
        while len(rows):
            place = joins.argmin(axis=1)
            lowest = joins[np.arange(len(rows)), place]
            done = lowest >= SHIFT
            if done.any():
                for row, ids in zip(rows[done], parts[done]):
                    found[row] = ids[ids != outside]
                live = ~done
                rows, parts, joins, place, lowest = (x[live] for x in (rows, parts, joins, place, lowest))
                if not len(rows):
                    break
            line, columns = np.arange(len(rows)), np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, columns + (columns > place[:, None]), axis=1)
            parts[line, place] = lowest
            columns = columns[:-1]
            joins = np.take_along_axis(joins, columns + (columns >= place[:, None]), axis=1)
            joins[line, place - 1] = become(parts[line, place - 1], lowest)
            joins[line, place] = become(lowest, parts[line, place + 1])
    return found


def merge_long(ids: np.ndarray, become) -> np.ndarray:
    """The same merges for one long word: a linked list of parts and a heap of pairs."""
    n = len(ids)
    parts, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(x, i) for i, x in enumerate(become(ids[:-1], ids[1:]).tolist()) if x < SHIFT]
    heapq.heapify(heap)
    current = {i: x for x, i in heap}

    def renew(i: int) -> None:
        current.pop(i, None)
        if i >= 0 and after[i] < n:
            x = int(become(np.int64(parts[i]), np.int64(parts[after[i]])))
            if x < SHIFT:
                current[i] = x
                heapq.heappush(heap, (x, i))

    while heap:
        x, i = heapq.heappop(heap)
        if current.get(i) != x:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = x, -1, after[gone]
        current.pop(gone, None)
        if after[i] < n:
            before[after[i]] = i
        renew(i)
        renew(before[i])
    return np.array([p for p in parts if p >= 0])


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n) over all texts: the matches of the pattern as UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, held = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(split(text or ""))
            if len(held) >= HELD_COUNTS:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    counted = docs.select("text").mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def encode(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
    known_words: int = KNOWN_WORDS, sample: int = SAMPLE,
) -> DataFrame:
    """`docs` with the added column `ids` array<int>; a column of this name is replaced.

    Each match of the pattern is encoded by itself, as one token if it is one, else by merges; special
    tokens are ordinary text. Null and empty texts
    have no ids. Rows come back one for one, repeated ones too; an empty table gives an empty result.
    `path` is read on the driver. Very long texts are encoded whole. The `known_words` most frequent words of every
    `sample`-th text by a hash (ties by word) are encoded once and sent to all tasks, which bounds what is sent; every
    other word is encoded where it is met, so the ids are the same for all values of both.
    """
    spark, source = docs.sparkSession, col(text)
    bounded_batches(spark)
    ranks = load_ranks(path)
    whole = {w: i for p, i in ranks.items() if (w := p.decode(errors="ignore")).encode() == p}
    tokens = F.broadcast(spark.createDataFrame(pd.DataFrame({"word": list(whole)}), "word string"))
    drawn = docs.select(source.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    counts = count_words(drawn, pattern).join(tokens, "word", "left_anti")
    top = counts.orderBy(F.desc("n"), "word").limit(known_words)
    spread = top.select(F.encode("word", "UTF-8").alias("word")).repartition(
        4 * spark.sparkContext.defaultParallelism)  # the limit leaves one part
    with short_plan_texts(spark):
        stored = cut_lineage(encode_words(spread, path))
    packed = stored.select(F.decode("word", "UTF-8").alias("word"), "ids").toArrow()
    words, found = packed["word"].to_pylist(), packed["ids"]
    known = {w: i for i, w in enumerate([*whole, *words])}
    flat = np.concatenate([list(whole.values()), *[c.flatten().to_numpy() for c in found.chunks]]).astype(np.int32)
    sizes = [np.ones(len(whole), np.int64), *[c.value_lengths().to_numpy() for c in found.chunks]]
    ends = np.append(0, np.cumsum(np.concatenate(sizes)))
    shared = spark.sparkContext.broadcast((known, flat, ends, ranks, pair_rows(path)))

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, flat, ends, ranks, pairs = shared.value
        split, numbers = regex.compile(pattern).findall, None
        for batch in texts:
            if numbers is None or len(numbers) > len(known) + HELD_WORDS:
                numbers, both, limits = _Numbers(known), flat, ends
            found = [
                np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
                for w in (split(t or "") for t in batch)
            ]
            if numbers.new:
                own = fold_words([w.encode() for w in numbers.new], ranks, pairs)
                numbers.new.clear()
                both = np.concatenate([both, *own])
                limits = np.append(limits, limits[-1] + np.cumsum([len(x) for x in own]))
            yield pd.Series([_gather(both, limits, n) for n in found])

    return docs.withColumn("ids", run(source))


class _Numbers(dict):
    """Numbers of words; a new word gets the next one and is listed in `new`."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def _gather(flat: np.ndarray, limits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The stretches limits[k]..limits[k + 1] of `flat` for all numbers k, one after the other."""
    first, size = limits[numbers], limits[numbers + 1] - limits[numbers]
    shift = np.repeat(first - np.append(0, np.cumsum(size)[:-1]) if len(size) else first, size)
    return flat[shift + np.arange(len(shift))].astype(np.int32)


def decode(ids: Column, path: str) -> Column:
    """The bytes of token ids: their pieces, looked up in an array literal, one after the other. Null stays
    null; an id that is none adds nothing."""
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    table = literal(pieces, "array<string>")
    text = _let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return F.encode(text, "ISO-8859-1")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and decoded_sha256."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest() for x in batch], dtype=object)

    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"), "ids_sha256": digest("ids"),
        "decoded_sha256": F.sha2(decode(F.col("ids"), path), 256),
    })


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = digests(encode(docs, path, public_tokenizers.PATTERN).drop("text"), path)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
