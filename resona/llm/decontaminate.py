"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each shard holds the postings of its documents, a sorted position list
per term, where positions run through the shard's documents one after the other. It is stored as a table
with one row per shard. The distinct phrases of the benchmark are a stored table too. How many shards have a
term is counted over the whole index; a phrase goes only to the shards that have the rarest of its terms, by a join on
that term, and nowhere if no shard has one of them. There the search starts with the term that is rarest in the shard
and intersects the lists of the other terms, moved by their offsets, in ascending order of length. Hits carry the
phrase; the items that have it are joined at the end. Terms are 64-bit hashes of words. Only terms that some phrase
uses, and the few others that pass a bitmap of them, get a posting list.
"""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import as_id, as_text, bounded_batches, col, read, scratch
from resona.llm.passages import Membership
from resona.session import cut_lineage

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
SHARD_WORDS = 400_000  # a shard is closed once it holds so many words; a longer document has one alone
BLOCK_PHRASES = 50_000  # phrases that meet a shard at once, about

SHARD = (
    "shard long, starts array<int>, terms array<long>, offsets array<int>, positions array<int>, "
    "ids array<string>, keys array<long>, sizes array<int>"
)
PHRASES = "phrase long, terms array<long>, items array<string>"
HIT = "struct<first:int,last:int,phrase:long,near:boolean>"
HITS = f"shard long, doc int, hits array<{HIT}>"


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; null has none."""
    return WORD.findall((text or "").encode().lower())


def windows(tokens: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of `size` words; a shorter text is one run, an empty one has none."""
    size = min(size, len(tokens))
    return set(zip(*(tokens[i:] for i in range(size)))) if size else set()


def hashed(tokens: Iterable[bytes], size: int) -> np.ndarray:
    """64-bit hashes of `size` words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, size).view(np.int64)


def post(documents: list[np.ndarray], known: Membership) -> dict:
    """The index columns of one shard: documents as terms, those of `known` with a posting list."""
    starts = np.cumsum([0, *map(len, documents)])
    terms = np.concatenate(documents)
    positions = np.flatnonzero(known.has(terms))
    order = np.argsort(terms[positions], kind="stable")
    positions = positions[order].astype(np.int32)
    used, first = np.unique(terms[positions], return_index=True)
    return {"starts": starts, "terms": used, "positions": positions,
            "offsets": np.append(first, len(positions)).astype(np.int32)}


def member(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted list."""
    at = np.searchsorted(sorted_list, values)
    return (at < len(sorted_list)) & (sorted_list[np.minimum(at, len(sorted_list) - 1)] == values)


def lookup(shard, phrases: list[list[int]], slack: int | None = None) -> Iterator[tuple]:
    """(document, first word, last word, phrase, near) of every match in a shard.

    Exact matches are phrases word by word. With `slack`, a place where all terms lie within the phrase
    length plus `slack` words around a word of the rarest term is reported as a near match.
    """
    starts, positions = np.asarray(shard.starts), np.asarray(shard.positions)
    at = {t: (a, b) for t, a, b in zip(shard.terms, shard.offsets, shard.offsets[1:])}

    def postings(term: int) -> np.ndarray:
        a, b = at[term]
        return positions[a:b]

    for number, phrase in enumerate(phrases):
        if not all(t in at for t in phrase):
            continue
        order = sorted(range(len(phrase)), key=lambda i: at[phrase[i]][1] - at[phrase[i]][0])
        begin = postings(phrase[order[0]]) - order[0]
        for i in order[1:]:
            if not len(begin):
                break
            begin = begin[member(postings(phrase[i]), begin + i)]
        if len(begin):
            doc = np.searchsorted(starts, begin, side="right") - 1
            inside = begin + len(phrase) <= starts[doc + 1]
            for d, p in zip(doc[inside], begin[inside]):
                yield int(d), int(p - starts[d]), int(p - starts[d] + len(phrase) - 1), number, False
        if slack is not None:
            reach = len(phrase) + slack - 1
            centre = postings(phrase[order[0]])
            doc = np.searchsorted(starts, centre, side="right") - 1
            low, high = np.maximum(centre - reach, starts[doc]), np.minimum(centre + reach, starts[doc + 1] - 1)
            for i in order[1:]:
                own = postings(phrase[i])
                kept = np.searchsorted(own, low) < np.searchsorted(own, high, side="right")
                centre, doc, low, high = centre[kept], doc[kept], low[kept], high[kept]
            for c, d, lo, hi in zip(centre, doc, low, high):
                if span := covering(postings, phrase, int(c), int(lo), int(hi), reach):
                    yield int(d), span[0] - int(starts[d]), span[1] - int(starts[d]), number, True


def covering(postings, phrase: list[int], centre: int, low: int, high: int, reach: int):
    """The first stretch of at most reach + 1 words that holds `centre` and all terms of the phrase."""
    lists = []
    for t in set(phrase):
        own = postings(t)
        lists.append(own[np.searchsorted(own, low):np.searchsorted(own, high, side="right")])
    for begin in sorted({int(p) for own in lists for p in own if p <= centre}):
        at = [np.searchsorted(own, begin) for own in lists]
        if all(i < len(own) for i, own in zip(at, lists)):
            end = max(centre, *(int(own[i]) for i, own in zip(at, lists)))
            if end - begin <= reach:
                return begin, end
    return None


def phrase_rows(items: DataFrame, window: int) -> DataFrame:
    """PHRASES: the distinct windows of the rows (item, text) with a hash of each, its terms, and the ids of the items that
    have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                found = [b" ".join(w).decode() for w in windows(words(text), window)]
                yield pd.DataFrame({"window": found, "item": [item] * len(found)}, dtype=object)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [w.encode().split(b" ") for w in batch["window"]]
            yield pd.DataFrame({
                "phrase": batch["phrase"], "terms": [hashed(t, len(t)) for t in split], "items": batch["items"]})

    owned = items.mapInPandas(run, "window string, item string").groupBy("window").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return owned.withColumn("phrase", F.xxhash64("window")).mapInPandas(terms, PHRASES)


def wanted(phrases: DataFrame, lists: DataFrame, block_phrases: int) -> DataFrame:
    """(shard, phrases): the phrases that each shard is searched for, in blocks of about `block_phrases`."""
    having = lists.select("shard", F.explode("terms").alias("term"))
    spread = having.groupBy("term").agg(F.count("*").alias("shards"))
    each = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term"))
    rarest = each.join(spread, "term", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("shards", F.lit(0)).alias("shards"), "term")).alias("least"))
    placed = rarest.where("least.shards > 0").select("phrase", F.col("least.term").alias("term")).join(having, "term")
    met = cut_lineage(placed.select("shard", "phrase"))
    sizes = met.groupBy("shard").agg(F.ceil(F.count("*") / block_phrases).alias("blocks"))
    block = F.pmod(F.col("phrase"), F.col("blocks")).alias("block")
    rows = met.join(sizes, "shard").select("shard", block, "phrase").join(phrases.select("phrase", "terms"), "phrase")
    return rows.groupBy("shard", "block").agg(F.collect_list(F.struct("phrase", "terms")).alias("phrases")).drop("block")


def occurrences(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slack: int | None = None,
    block_phrases: int = BLOCK_PHRASES,
) -> DataFrame:
    """One row per document row: doc_id, key (xxhash64 of doc_id and text), n_words, `hits`, an array of (first, last,
    phrase, near): word positions of each match of a benchmark window, and `items`, the ids of all items that have
    one of these windows, sorted.

    The documents are read and indexed once, and a shard meets at most about `block_phrases` phrases at once; the driver
    holds no text, only a bitmap of terms. Null texts have no words, null item texts and ids no windows, empty tables
    give no rows or no hits. A very long document has a shard of its own. Repeated rows are kept; other columns are not
    read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    items = benchmark.select(col(item_id).cast("string").alias("item"), col(item_text).alias("text")).dropna()
    phrases = cut_lineage(phrase_rows(items, window))

    used = cut_lineage(phrases.select(F.explode("terms").alias("term")).distinct())
    known = spark.sparkContext.broadcast(Membership.of(used, "term"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, ids, keys, number = [], 0, [], [], TaskContext.get().partitionId() << 32

        def closed() -> pd.DataFrame:
            return pd.DataFrame([post(held, known.value) | {
                "shard": number, "ids": list(ids), "keys": list(keys), "sizes": [len(t) for t in held]}])

        for batch in batches:
            for doc, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                tokens = words(text)
                held.append(hashed(tokens, len(tokens)))
                ids.append(doc)
                keys.append(key)
                count += len(tokens)
                if count >= SHARD_WORDS:
                    yield closed()
                    held, count, ids, keys, number = [], 0, [], [], number + 1
        if held:
            yield closed()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples():
                hits: dict[int, list] = {}
                phrases = [list(p["terms"]) for p in shard.phrases]
                for doc, first, last, at, near in lookup(shard, phrases, slack):
                    hits.setdefault(doc, []).append((first, last, shard.phrases[at]["phrase"], near))
                if hits:
                    yield pd.DataFrame(
                        {"shard": [shard.shard] * len(hits), "doc": list(hits), "hits": list(hits.values())})

    rows = source.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("doc_id", as_text("doc_id"))
    stored = cut_lineage(rows.select("doc_id", "key", "text").mapInPandas(index, SHARD))
    lists = stored.select("shard", "starts", "terms", "offsets", "positions")
    pairs = wanted(phrases, stored.select("shard", "terms"), block_phrases).join(lists, "shard")
    found = cut_lineage(pairs.mapInPandas(search, HITS))
    hits = found.groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    seen = found.select("shard", "doc", F.explode("hits.phrase").alias("phrase")).distinct()
    owners = phrases.select("phrase", F.explode("items").alias("item"))
    items = seen.join(owners, "phrase").groupBy("shard", "doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = stored.select("shard", F.posexplode(F.arrays_zip("ids", "keys", "sizes")).alias("doc", "row"))
    return each.join(hits, ["shard", "doc"], "left").join(items, ["shard", "doc"], "left").select(
        F.col("row.ids").cast("long").alias("doc_id"), F.col("row.keys").alias("key"), F.col("row.sizes").alias("n_words"),
        F.coalesce("hits", F.array().cast(f"array<{HIT}>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def judged(matches: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items, contaminated of each row of `occurrences`: a document is
    contaminated if at least a twentieth of its words lie in matches."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, key, size, hits, found in zip(*(batch[c] for c in ("doc_id", "key", "n_words", "hits", "items"))):
                hit = np.zeros(size + 1, np.int32)
                for h in hits:
                    hit[h["first"]] += 1
                    hit[h["last"] + 1] -= 1
                n_hit = int((np.cumsum(hit[:size]) > 0).sum())
                rows.append((doc, key, size, n_hit, len(found), list(found), n_hit > 0 and 20 * n_hit >= size))
            out = pd.DataFrame(
                rows, columns=["doc_id", "key", "n_words", "n_hit", "n_items", "items", "contaminated"])
            yield out

    return matches.withColumn("doc_id", as_text("doc_id")).mapInPandas(run, (
        "doc_id string, key long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"
    )).withColumn("doc_id", as_id("doc_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, key, n_words, n_hit, n_items, items (ids as text, sorted),
    contaminated. Cases as in `occurrences`."""
    return judged(occurrences(docs, benchmark))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` (with doc_id and text) that are not contaminated."""
    (key,) = scratch(docs, "key")
    found = cut_lineage(decontaminate(docs, benchmark).filter("contaminated").select(F.col("key").alias(key)).distinct())
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return keyed.join(found, key, "left_anti").select(*[col(c) for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
