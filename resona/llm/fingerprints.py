"""Document fingerprints by a homomorphic multiset hash.

Each paragraph becomes a wide vector and a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane modulo a power of two. The order of paragraphs does not matter, and adding or subtracting
the vector of a paragraph inserts or deletes it. The vector has two parts: four 64-bit lanes, hashes of
the whole paragraph, which tell documents apart; and 256 lanes of 32 bits, the sum of +1/-1 vectors of
the paragraph's word triples, whose differences estimate how much two documents share.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import as_id, as_text, bounded_batches, col, read

EXACT = 4  # 64-bit lanes modulo 2**64
LANES = 256  # 32-bit lanes modulo 2**32
SHINGLE = 3
MAX_PARTS = 4096  # parts are streamed in order, so their size is not a question of memory
PARTS_PER_PARTITION = 3  # evens out what each shuffle partition gets


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprint:
    """A sum of paragraph vectors; equal multisets of paragraphs have equal sums."""

    def __init__(self, exact: np.ndarray, lanes: np.ndarray):
        self.exact, self.lanes = exact, lanes

    @classmethod
    def of(cls, text: str | None) -> "Fingerprint":
        """Of a whole text, paragraph by paragraph; null and empty texts have one empty paragraph."""
        paragraphs = (text or "").split("\n")
        with np.errstate(over="ignore"):
            exact = np.array([
                [xxhash.xxh64_intdigest(p, seed) for seed in range(EXACT)] for p in paragraphs
            ], np.uint64).sum(axis=0, dtype=np.uint64)
        words, ends = [], []
        for p in paragraphs:
            words += p.split()
            ends.append(len(words))
        return cls(exact, cls._lanes(words, ends))

    @staticmethod
    def _lanes(words: list[str], ends: list[int]) -> np.ndarray:
        """Sum of the +1/-1 vectors of all triples that lie in one paragraph, and of all words of
        paragraphs with fewer than three."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        owner = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        if len(words) >= SHINGLE:
            with np.errstate(over="ignore"):
                triples = (
                    _mixed(hashes[:-2]) + _mixed(hashes[1:-1] + np.uint64(1)) * np.uint64(3)
                    + _mixed(hashes[2:] + np.uint64(2)) * np.uint64(5)
                )[owner[:-2] == owner[2:]]
            short = np.diff([0, *ends]) < SHINGLE
            elements = np.concatenate([triples, hashes[short[owner]]])
        else:
            elements = hashes
        total = np.zeros(LANES, np.int64)
        for start in range(0, len(elements), 2048):
            block = elements[start:start + 2048]
            with np.errstate(over="ignore"):
                bits = np.stack([_mixed(block + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
                                 for k in range(LANES // 64)], axis=1)
            ones = np.unpackbits(bits.view(np.uint8).reshape(len(block), -1), axis=1)
            total += 2 * ones.sum(axis=0, dtype=np.int32) - len(block)
        return total.astype(np.uint32)

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        """Insert the paragraphs of another fingerprint."""
        return Fingerprint(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        """Delete them again."""
        return Fingerprint(self.exact - other.exact, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    def __hash__(self) -> int:
        return hash(self.hex())

    def hex(self) -> str:
        return self.exact.astype(">u8").tobytes().hex() + self.lanes.astype(">u4").tobytes().hex()

    def likeness(self, other: "Fingerprint") -> float:
        """Share of common word triples (2 * common / all), estimated from the lanes; 1 if equal."""
        if (self.exact == other.exact).all():
            return 1.0
        a, b = (x.lanes.view(np.int32).astype(float) for x in (self, other))
        difference = (self.lanes - other.lanes).view(np.int32).astype(float)
        size = a @ a + b @ b
        return float(np.clip(1 - difference @ difference / size, 0, 1)) if size else 0.0


def _key():
    return F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "mark")


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) in sorted parts: columns part, own, doc_id, mark, text.

    Documents are ordered by doc_id, nulls first, then by `mark`, a hash of the text. Each part holds a
    stretch of that order and, as a row with own = false after it, the first document of the next part
    (after the last part: of the first), so every document meets its successor in its own part. Texts are
    shuffled once; the driver holds the first key of each part.
    """
    spark = docs.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    spans = (
        marked.select("doc_id", "mark")
        .repartitionByRange(
            min(PARTS_PER_PARTITION * wanted, MAX_PARTS),
            F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("mark"))
        .withColumn("span", F.spark_partition_id())
    )
    first = spans.groupBy("span").agg(F.min(_key()).alias("key")).select("key").distinct()
    heads = sorted(
        (tuple(r["key"]) for r in first.collect()), key=lambda k: (k[0], k[1] if k[0] else 0, k[2]))
    if not heads:
        return marked.select(F.lit(0).alias("part"), F.lit(True).alias("own"), "doc_id", "mark", "text")
    literal = F.array(*[
        F.struct(F.lit(has).alias("has"), F.lit(i).cast("long").alias("doc_id"), F.lit(m).cast("long").alias("mark"))
        for has, i, m in heads
    ])
    placed = marked.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_key", _key())
    placed = placed.withColumn("part", F.size(F.filter(literal, lambda h: h <= F.col("_key"))) - 1)
    before = F.when(F.col("part") > 0, F.col("part") - 1).otherwise(len(heads) - 1)
    is_head = literal[F.col("part")] == F.col("_key")
    places = F.when(
        is_head,
        F.array(F.struct(F.col("part"), F.lit(True).alias("own")),
                F.struct(before.alias("part"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(F.col("part"), F.lit(True).alias("own"))))
    return (
        placed.select(F.inline(places), "doc_id", "mark", "text").repartition(wanted, "part")
        .sortWithinPartitions("part", F.desc("own"), F.asc_nulls_first("doc_id"), "mark")
    )


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


OUT = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, pending = None, None  # pending: key, number of copies, text, fingerprint

    def row(following: str, other: Fingerprint) -> list[tuple]:
        (key, _), copies, text, own = pending
        changed = edited(text, following)
        after = Fingerprint.of(changed)
        return [(
            key, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), after.hex(),
            own.likeness(after), own.likeness(other),
        )] * copies

    for batch in batches:
        out = []
        for at, own, doc_id, mark, text in batch.itertuples(index=False, name=None):
            text, key = text or "", (doc_id, mark)
            if at != part:
                part, pending = at, None
            if own and pending and pending[0] == key:
                pending = (key, pending[1] + 1, *pending[2:])
                continue
            found = Fingerprint.of(text)
            if pending:
                out += row(text, found)
            pending = (key, 1, text, found) if own else None
        names = [c.split()[0] for c in OUT.split(", ")]
        if out:
            yield pd.DataFrame(out, columns=names)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: the columns of OUT, for the text, its edited text (see `edited`, with the
    next document by doc_id; after the last the first) and their likeness.

    Null texts count as empty. Null ids come first. Rows with the same doc_id are ordered by a hash of
    their text; exactly repeated rows stand as one document in the order and come back as often as they
    went in. A single document is its own successor. An empty table gives an empty result; other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)
    chosen = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    parts = with_next(chosen).select("part", "own", as_text("doc_id").alias("doc_id"), "mark", "text")
    return parts.mapInPandas(_compare, OUT).withColumn("doc_id", as_id("doc_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(read(spark, sf_dir, "documents"))
