"""Quality by importance resampling: how much likelier a text is under a model of good texts than under
one of all texts, both hashed n-gram models, and a weighted sample without replacement by Gumbel top-k."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, read
from resona.session import cut_lineage

BUCKETS = 1 << 16
PRIOR = 1000.0  # n-grams of the raw model that are added to the target's
TARGET_DOCS = 20_000  # good documents that the target model is fitted on at most, the first by a hash
SHARE = 0.5  # of the documents that are drawn
SEED = 42
TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> np.ndarray:
    """Hash buckets of the words, marks and neighbouring pairs of a text, repeats included."""
    tokens = TOKEN.findall((text or "").lower())
    one = np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = np.concatenate([one * np.uint64(0xFF51AFD7ED558CCD), two])
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) % BUCKETS


def counts(texts: DataFrame) -> np.ndarray:
    """n-grams per bucket over all rows of a table with the column `text`: each task adds up its own, so
    BUCKETS rows per task are shuffled and BUCKETS numbers gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(features(text), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    summed = texts.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    out = np.zeros(BUCKETS)
    out[found["bucket"]] = found["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """By bucket, with the target model drawn towards the raw one, so what is too rare to tell weighs little."""
    q = (raw + 1) / (raw + 1).sum()
    p = (target + PRIOR * q) / (target.sum() + PRIOR)
    return np.log(p / q)


def log_weight(spark: SparkSession, ratio: np.ndarray, text: Column, most: int | None = None) -> Column:
    """Log importance weight: the sum of the log ratios of all n-grams of a text; with `most`, of that many n-grams at
    the text's mean where it has more."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = []
            for text in batch:
                own = features(text)
                scale = most / len(own) if most and len(own) > most else 1.0
                found.append(shared.value[own].sum() * scale)
            yield pd.Series(found, dtype="float64")

    return run(text)


def gumbel(*keys: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the keys: the same for the same row in every run."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def ranked(rows: DataFrame, by: Column, tie: list[str]) -> DataFrame:
    """`rows` with `rank`, from 1 by falling `by`: range parts are sorted and numbered each by itself, and
    the sizes of the parts before are added."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # spreads rows that are equal in all keys
    order = [by.desc(), *[F.asc_nulls_first(c) for c in tie], F.asc("salt")]
    stored = cut_lineage(salted.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = stored.groupBy("part").agg(F.count("*").alias("n")).collect()
    before, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets += [F.lit(row["part"]), F.lit(before).cast("long")]
        before += row["n"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    start = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0).cast("long")
    return stored.withColumn("rank", start + place).drop("part", "salt")


def resample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", share: float = SHARE, seed: int = SEED,
    target_docs: int = TARGET_DOCS, most_ngrams: int | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, log_weight, gumbel_key, rank, selected.

    The target model counts the texts of up to `target_docs` documents whose label is 1 (their ids are
    what is broadcast), the raw model the texts of all rows. The first ceil(share * rows) by falling log_weight + Gumbel noise are selected, which draws without
    replacement in proportion to the weights. Noise comes from doc_id and text, so exactly repeated rows
    share their key and stand next to each other. Null and empty texts weigh 0; without target texts
    all weights are 0. Very long texts weigh with all their n-grams, so the noise decides little about them; with
    `most_ngrams` the evidence of a text counts as that of so many n-grams. Null ids are kept; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    good = cut_lineage(
        labels.filter(col(label) == 1).select(col(doc_id).alias("doc_id")).dropna().distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)
    )
    raw = counts(rows.select("text"))
    target = counts(rows.join(F.broadcast(good), "doc_id", "left_semi").select("text"))
    ratio = log_ratio(target, raw) if target.any() else np.zeros(BUCKETS)
    key = F.col("log_weight") + gumbel(F.coalesce("doc_id", F.lit(-1)), F.col("mark"), seed=seed)
    weighed = cut_lineage(rows.select(  # stored, for range partitioning reads it twice
        "doc_id", F.xxhash64("text").alias("mark"),
        log_weight(spark, ratio, F.col("text"), most_ngrams).alias("log_weight"),
    ))
    found = ranked(weighed.withColumn("gumbel_key", key), F.col("gumbel_key"), ["doc_id", "mark"])
    total = cut_lineage(found)
    wanted = -(-int(total.count() * share * 1_000_000) // 1_000_000)
    return total.select(
        "doc_id", "log_weight", "gumbel_key", F.col("rank").cast("long").alias("rank"),
        (F.col("rank") <= wanted).alias("selected"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
