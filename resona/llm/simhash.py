"""SimHash near-duplicates, found exactly with vantage-point trees over Hamming distance.

Fingerprints are spread over shards by the top of a vantage-point tree fitted on a bounded sample: a node
sends what lies within `radius_of_node` of its vantage point inside, the rest outside. By the triangle
inequality a pair at distance r that a node parts has its inner end at `radius_of_node + 1 - r` or
further, so only that rim of inner points is handed to the outer side too. Every pair in reach therefore
meets in at least one shard. In a shard the same tree goes on down to small leaves, where distances are
counted pair by pair; a leaf gives the links of its own spanning stars, not all pairs.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, components, read, scratch
from resona.session import cut_lineage

SEED = 42  # of XXH64
LEAF = 512  # points compared pair by pair
SHARD = 40_000  # distinct fingerprints a shard is meant to hold
SAMPLE_PER_SHARD = 64  # sampled fingerprints per shard to fit the top of the tree


def fingerprint_of(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingle hashes have it. No words: 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not words:
        return 0
    n = min(words_per_shingle, len(words))
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = map(join, zip(*(words[i:] for i in range(n))))
    ones, total = np.zeros(64, np.int64), len(words) - n + 1
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, total)
    for start in range(0, total, 4096):
        block = hashes[start:start + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def fingerprint(text: Column, words_per_shingle: int = 3) -> Column:
    """The SimHash of a text as a signed long; null counts as empty."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t, words_per_shingle) for t in batch], dtype="int64")

    return run(text)


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def split(points: np.ndarray, seed: int) -> tuple[int, int] | None:
    """A vantage point among the points and the radius that parts them best; None if none parts them."""
    rng, best = np.random.default_rng(seed), None
    for vantage in points[rng.integers(0, len(points), 3)]:
        seen = np.bincount(distances(points, vantage), minlength=65)
        inside = np.cumsum(seen)
        radius = int(np.argmin(np.abs(inside - len(points) / 2)))
        larger = max(inside[radius], len(points) - inside[radius])
        if best is None or larger < best[0]:
            best = (larger, int(vantage), radius)
    return best[1:] if best[0] <= 0.9 * len(points) else None


def sides(points: np.ndarray, vantage: int, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the inner side, and of the outer side with the rim that may link to it."""
    d = distances(points, np.uint64(vantage)).astype(np.int64)
    return np.flatnonzero(d <= radius), np.flatnonzero(d > radius - reach)


def stars(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the points to the first point of their component, from all their distances."""
    near = distances(points[:, None], points[None, :]) <= reach
    alone = near.sum(axis=1) == 1
    if alone.all():
        return points[:0], points[:0]
    some = np.flatnonzero(~alone)
    near, label = near[np.ix_(some, some)], np.arange(len(some))
    while True:
        new = np.where(near, label[None, :], len(some)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(some))
    return points[some[moved]], points[some[label[moved]]]


def links_within(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span all components of distinct points at `reach` bits or fewer."""
    found, left = [], [(points, 1)]
    while left:
        part, seed = left.pop()
        cut = split(part, seed) if len(part) > LEAF else None
        if cut:
            inner, outer = sides(part, *cut, reach)
            if max(len(inner), len(outer)) <= 0.95 * len(part):
                left += [(part[inner], 2 * seed), (part[outer], 2 * seed + 1)]
                continue
        blocks = range(0, len(part), LEAF // 2)
        for a in blocks:
            for b in [x for x in blocks if x > a] or [a]:
                first, second = part[a:a + LEAF // 2], part[b:b + LEAF // 2]
                found.append(stars(first if a == b else np.concatenate([first, second]), reach))
    pairs = [np.concatenate(x) for x in zip(*found)] if found else [points, points]
    return pairs[0], pairs[1]


def fit_top(sample: np.ndarray, shards: int, reach: int) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer) of the top tree; a negative child -1-k is shard k."""
    nodes, leaves = [], 0

    def grow(points: np.ndarray, wanted: int, seed: int) -> int:
        nonlocal leaves
        cut = split(points, seed) if wanted > 1 and len(points) > 8 else None
        if not cut:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        inner, outer = sides(points, *cut, 0)
        half = (wanted + 1) // 2
        nodes[at] = (*cut, grow(points[inner], half, 2 * seed), grow(points[outer], half, 2 * seed + 1))
        return at

    grow(sample, shards, 1)
    return nodes


def route(points: np.ndarray, nodes: list[tuple], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) for every shard that a point belongs to."""
    shards, rows = [], []
    left = [(0 if nodes else -1, np.arange(len(points)))]
    while left:
        at, index = left.pop()
        if at < 0:
            shards.append(np.full(len(index), -1 - at))
            rows.append(index)
        elif len(index):
            vantage, radius, inside, outside = nodes[at]
            inner, outer = sides(points[index], vantage, radius, reach)
            left += [(inside, index[inner]), (outside, index[outer])]
    return np.concatenate(shards), np.concatenate(rows)


def hamming_links(fingerprints: DataFrame, max_bits: int = 2, shard_size: int = SHARD) -> DataFrame:
    """(a, b): links that span the components of distinct longs `fp` at `max_bits` bits or fewer.

    The driver holds a sample of SAMPLE_PER_SHARD fingerprints per shard and one tree node per shard.
    """
    points = cut_lineage(fingerprints.select("fp").filter("fp is not null").distinct())
    shards = -(-points.count() // shard_size)
    nodes = []
    if shards > 1:
        wanted = SAMPLE_PER_SHARD * shards
        sample = points.orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()
        nodes = fit_top(np.array([r[0] for r in sample], np.int64).view(np.uint64), shards, max_bits)

    def spread(batches):
        for batch in batches:
            shard, row = route(batch["fp"].to_numpy().view(np.uint64), nodes, max_bits)
            yield pd.DataFrame({"shard": shard, "fp": batch["fp"].to_numpy()[row]})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        found = links_within(shard["fp"].to_numpy().view(np.uint64), max_bits)
        return pd.DataFrame({"a": found[0].view(np.int64), "b": found[1].view(np.int64)})

    spreading = points.mapInPandas(spread, "shard long, fp long")
    return spreading.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    words_per_shingle: int = 3, max_bits: int = 2,
) -> DataFrame:
    """One row per row of `docs`: doc_id, key (xxhash64 of doc_id and text), fp, component_id, first.

    Two documents link if their fingerprints differ in at most `max_bits` bits. `first` is the key of the
    component's first row by doc_id, nulls last, then by key; component_id is that row's doc_id.
    """
    bounded_batches(docs.sparkSession)
    marked = cut_lineage(docs.select(
        col(doc_id).alias("doc_id"), F.xxhash64(col(doc_id), col(text)).alias("key"),
        fingerprint(col(text), words_per_shingle).alias("fp"),
    ))
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    first = cut_lineage(marked.groupBy("fp").agg(F.min(row).alias("row")))
    roots = components(hamming_links(first, max_bits)).withColumnRenamed("node", "fp")
    rooted = first.join(roots, "fp", "left").select("fp", "row", F.coalesce("root", "fp").alias("root"))
    smallest = cut_lineage(rooted.groupBy("root").agg(F.min("row").alias("least")))
    owner = cut_lineage(rooted.join(smallest, "root").select(
        "fp", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first")))
    return marked.join(owner, "fp").select("doc_id", "key", "fp", "component_id", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id
    reachable over links.

    Null and empty texts have fingerprint zero and link to each other like any others. Repeated rows come
    back as often as they went in. A null doc_id is kept; component_id is null only if no document of the
    component has an id. An empty table gives an empty result; other columns are not read. Options as in
    `classes`.
    """
    found = classes(docs, doc_id, text, **options)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", shown, "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of `docs` for each component of `classes`, its first; equal rows are one."""
    (key,) = scratch(docs, "key")
    firsts = cut_lineage(classes(docs, doc_id, text, **options).select(F.col("first").alias(key)).distinct())
    keyed = docs.withColumn(key, F.xxhash64(col(doc_id), col(text)))
    return keyed.join(firsts, key).dropDuplicates([key]).select(*[col(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=2)
