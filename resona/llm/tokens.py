"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A byte-level tokenizer first cuts a text into special tokens and words, scanning from left to right. Where
the scan stands at a boundary, what follows depends on the text from there on and nothing before; and a
boundary depends on the text behind it only as far as a special token or a contraction reaches (`margin`).
So a boundary that the scan of one chunk finds at least `margin` before its end, and that the scan of the
next chunk finds too, is a boundary of the whole text, and behind it both scans go the same way: there
the two are spliced. Boundaries between tokens of one word prove nothing and are not used.

The library's own cutting into words takes most of its time, so a task cuts texts by the same pattern and asks the
library for each distinct word once, as long as it remembers it. Texts with special strings, or with code points that
are too new for all tables of letters to agree on, go to the library whole.

Chunks of a huge document are encoded in different tasks; each tells its boundaries in the overlaps with the
number of tokens before them. Where an overlap has no common boundary, the document is done again with
wider chunks and overlaps, at last as one chunk.
"""

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, read, scratch
from resona.session import cut_lineage

CHUNK = 1 << 15  # code points; longer texts are cut
OVERLAP = 256  # code points that a chunk reads of the next one at first
WIDER = 8  # times wider chunks and overlaps after a failed alignment
LIMIT = 1024  # tokens of a context, for over_limit
HELD_WORDS = 400_000  # words whose number of tokens a task remembers before it begins anew

UNSURE = -(1 << 40)  # instead of the number of tokens, for words that not all tables cut alike

# Fixed value: the pattern by which byte-level tokenizers cut words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ENDS = "row long, k long, last boolean, total long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


@lru_cache(1)
def tokenizer(source: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(source)
    made.no_truncation()
    made.no_padding()
    return made


def margin(source: str) -> int | None:
    """How many code points behind a boundary can decide about it; None for tokenizers other than byte-level
    ones with plain special tokens, whose boundaries prove nothing."""
    made = json.loads(source)
    words, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
    special = [a["content"] for a in added]
    plain = (
        made.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex", True)
        and not words.get("add_prefix_space") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        and not any(a[-n:] == b[:n] for a in special for b in special for n in range(1, min(len(a), len(b)) + (a != b)))
    )
    return max(map(len, special), default=0) + 4 if plain else None


def boundaries(made, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Where words and special tokens begin, the number of tokens before each, and that of all."""
    found = made.encode(text, add_special_tokens=False)
    words = np.array(found.word_ids, np.int64)
    first = np.flatnonzero(np.diff(words, prepend=-1))
    offsets = found.offsets
    return np.array([offsets[i][0] for i in first], np.int64), first, len(words)


@cache
def unassigned() -> frozenset[str]:
    """The code points without a meaning in this Python's Unicode version, which newer tables may call letters."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")


class Counter(dict):
    """Numbers of tokens by word, as the library gives them."""

    def __init__(self, source: str):
        super().__init__()
        self.made = tokenizer(source)
        self.plain = margin(source) is not None
        self.special = [a["content"] for a in json.loads(source).get("added_tokens") or []]
        self.split = regex.compile(WORDS).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        known = word.isascii() or unassigned().isdisjoint(word)
        n = self[word] = len(self.made.encode(word, add_special_tokens=False)) if known else UNSURE
        return n

    def words(self, text: str) -> list[str] | None:
        """The words of a text; None if only the library can tell them."""
        return self.split(text) if self.plain and not any(s in text for s in self.special) else None

    def count(self, text: str) -> int:
        words = self.words(text)
        total = UNSURE if words is None else sum(map(self.__getitem__, words))
        return total if total >= 0 else len(self.made.encode(text, add_special_tokens=False))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        words = self.words(text)
        counts = [UNSURE] if words is None else [0, *map(self.__getitem__, words)]
        if min(counts) < 0:
            return boundaries(self.made, text)
        place, before = np.cumsum([0, *map(len, words)]), np.cumsum(counts)
        return place[:-1], before[:-1], int(before[-1])


@lru_cache(1)
def counter_of(source: str) -> Counter:
    """One per worker: what it remembers serves all its tasks."""
    return Counter(source)


def cut(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(row, k, last, start, piece): the chunks of (row, text), each with the overlap behind it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in batch.itertuples(index=False, name=None):
                starts = list(range(0, len(text), size))
                for at in range(0, len(starts), 64):
                    own = starts[at:at + 64]
                    yield pd.DataFrame({
                        "row": row, "k": [s // size for s in own], "last": [s + size >= len(text) for s in own],
                        "start": own, "piece": [text[s:s + size + overlap] for s in own],
                    })

    return texts.select("row", "text").mapInPandas(run, "row long, k long, last boolean, start long, piece string")


def counted(texts: DataFrame, source: str, size: int, overlap: int, behind: int) -> DataFrame:
    """(row, n): the number of tokens of each (row, text); null where an overlap has no common boundary.

    What a document's chunks tell is brought together: a text has less than 2**31 bytes, so at most 2**31 /
    size rows with two short lists each.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(source)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(shared.value)
        for batch in batches:
            out = []
            for row, k, last, start, piece in batch.itertuples(index=False, name=None):
                place, before, total = counter.boundaries(piece)
                head = place < overlap
                tail = (place >= size) & (place <= len(piece) - behind)
                out.append((row, k, last, total, place[head] + start, before[head], place[tail] + start, before[tail]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDS.split(", ")])

    spread = cut(texts, size, overlap).repartition("row", "k")
    ends = cut_lineage(spread.mapInPandas(run, ENDS))
    order = Window.partitionBy("row").orderBy("k")
    seams = ends.withColumns({"next": F.lead("head").over(order), "next_n": F.lead("head_n").over(order)})
    seams = seams.withColumn("at", F.array_min(F.array_intersect("tail", "next")))

    def before(places: str, counts: str):
        return F.get(F.col(counts), (F.array_position(F.col(places), F.col("at")) - 1).cast("int"))

    own = F.when(F.col("last"), F.col("total")).otherwise(before("tail", "tail_n") - before("next", "next_n"))
    found = seams.groupBy("row").agg(F.sum(own).alias("n"), F.count(own).alias("known"), F.count("*").alias("all"))
    return found.select("row", F.when(F.col("known") == F.col("all"), F.col("n")).alias("n"))


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` with n_bytes (UTF-8) and n_tokens of the whole text; columns of these names are replaced, others
    stay, whatever their names. `path` is a tokenizer as JSON, read on the driver.

    Counts are those of the tokenizers library without added tokens, truncation or padding; special strings
    inside a text count as one token, its default. Null and empty texts have 0 bytes and 0 tokens. Rows come
    back one for one, repeated ones and null ids too; an empty table gives an empty result. Texts of over
    `chunk` code points are cut; the counts are the same for every `chunk` and `overlap`. A very long text
    without any boundary (one word of a million letters) is at last encoded in one task. Tokenizers for which
    `margin` is None encode every text whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = open(path, encoding="utf-8").read()
    behind = margin(source)
    shared = spark.sparkContext.broadcast(source)

    @F.pandas_udf("long")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(shared.value)
        for batch in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in batch], dtype="int64")

    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")]
    (row,) = scratch(docs, "row")
    value = F.coalesce(col(text), F.lit(""))
    kept = docs.select(*map(col, names), F.octet_length(value).cast("long").alias("n_bytes"))
    if behind is None:
        return kept.withColumn("n_tokens", whole(value))
    if overlap <= behind:
        raise ValueError(f"overlap must be over {behind}")
    is_long = F.coalesce(F.length(col(text)) > chunk, F.lit(False))
    short = kept.where(~is_long).withColumn("n_tokens", whole(value))
    held = cut_lineage(kept.where(is_long).withColumn(row, F.monotonically_increasing_id()))
    left = held.select(col(row).alias("row"), col(text).alias("text"))
    rounds, size = [], chunk
    while not left.isEmpty():
        found = cut_lineage(counted(left, source, size, overlap, behind))
        rounds.append(found.where("n is not null"))
        left = left.join(found.where("n is null").select("row"), "row", "left_semi")
        size, overlap = size * WIDER, overlap * WIDER
    for found in rounds:
        counts = found.select(col("row").alias(row), col("n").alias("n_tokens"))
        short = short.unionByName(held.join(counts, row).drop(row))
    return short


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
