"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import bounded_batches, col, read
from resona.session import cut_lineage

SIZES = (3, 4, 5, 6)  # n-gram lengths in bytes
BUCKETS = 1 << 20
DOCS_PER_CLASS = 4000  # labelled documents of each class that training reads at most
PRIOR = 5.0  # documents added to each class before the ratio is taken
LEAST_RATIO = 0.4  # weaker features are left out of the fit
PENALTY = 0.01


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of all character n-grams of a text in lower case, repeats included."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8).astype(np.uint64)
    found = [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        rolling = raw
        for size in range(2, max(SIZES) + 1):
            if size > len(raw):
                break
            rolling = rolling[:-1] * np.uint64(0x100000001B3) + raw[size - 1:]
            if size in SIZES:
                mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(found)


@dataclass
class Model:
    """Weight per bucket (classifier weight times ratio) and intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        hit = buckets(text)
        hit = hit[self.weights[hit] != 0]
        total = self.intercept + float(self.weights[np.unique(hit)].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def ratios(counts: pd.DataFrame, positives: int, total: int) -> np.ndarray:
    """Log ratio of the smoothed shares of positive and negative documents that have a bucket."""
    n, p = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n[counts["bucket"]], p[counts["bucket"]] = counts["n"], counts["p"]
    share = positives / total
    in_positive = (p + 2 * PRIOR * share) / positives
    in_negative = (n - p + 2 * PRIOR * (1 - share)) / (total - positives)
    return np.log(in_positive / in_negative)


def train(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS) -> Model:
    """Fit on `docs` (key, text) and `labels` (key, label 0 or 1, one row per key).

    The labelled documents read are bounded: the first `per_class` keys of each class by their hash.
    Their table of labels is what is broadcast, and what the driver gathers is one row per bucket.
    Without documents of both classes every score is the share of positive ones.
    """
    def first(label: int) -> DataFrame:
        return labels.filter(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(per_class)

    chosen = cut_lineage(first(0).unionByName(first(1)))

    @F.pandas_udf("array<int>")
    def distinct_buckets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(buckets(t)).astype(np.int32) for t in batch])

    rows = cut_lineage(docs.join(F.broadcast(chosen), "key").select(
        "label", distinct_buckets("text").alias("buckets")))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    if not 0 < size["p"] < size["n"]:
        share = size["p"] / size["n"] if size["n"] else 0.0
        return Model(np.zeros(BUCKETS), 40.0 if share else -40.0)
    counts = rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("label").alias("p")).toPandas()
    ratio = ratios(counts, size["p"], size["n"])
    kept = np.flatnonzero(np.abs(ratio) >= LEAST_RATIO)
    if not len(kept):
        share = size["p"] / size["n"]
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))

    @F.udf(VectorUDT())
    def scaled(found: list[int]):
        hit = np.asarray(found, np.int64)
        hit = hit[place[hit] >= 0]
        return Vectors.sparse(len(kept), place[hit], ratio[hit])

    even = size["n"] / 2  # both classes weigh as much
    weight = F.when(F.col("label") == 1, even / size["p"]).otherwise(even / (size["n"] - size["p"]))
    fitted = LogisticRegression(
        regParam=PENALTY, standardization=False, maxIter=60, featuresCol="x", labelCol="y", weightCol="w",
    ).fit(rows.select(
        scaled("buckets").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w")))
    weights = np.zeros(BUCKETS)
    weights[kept] = fitted.coefficients.toArray() * ratio[kept]
    return Model(weights, float(fitted.intercept))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability that a text is toxic; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return run(text)


def held_out(key: Column) -> Column:
    """Documents whose labels training never sees; a null id has no label."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """`docs` with the added columns held_out, score and predicted (1 from 0.5 up); columns of these
    names are replaced.

    Labels other than 0 and 1 and null keys are left out; a key labelled both ways counts as 1. Rows come
    back one for one, repeated ones too; empty and null texts get the score of an empty text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key = col(doc_id)
    known = (
        labels.select(key.alias("key"), col(label).cast("int").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
        .groupBy("key").agg(F.max("label").alias("label"))
    )
    model = train(docs.select(key.alias("key"), col(text).alias("text")), known)
    found = docs.withColumns({"held_out": held_out(key), "score": score(spark, model, col(text))})
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
