"""TF-IDF over word n-grams, with smoothed idf and unit-length vectors.

The vocabulary is found by aggregations: tasks count the terms of their rows in Arrow batches, Spark adds the counts
up. Its size is capped by `max_features`, so the fitted model stays small whatever the corpus. Applying it is row-local.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.session import cut_lineage

MAX_FEATURES = 1000
MAX_DF = 0.8
SIZES = (1, 2)
BLOCK = 1_000_000  # tokens that a task encodes at once, or those of one row if it has more


def ngrams(tokens: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Tokens of two and more characters, and the pairs of neighbours among them."""
    words = F.filter(tokens, lambda t: F.length(t) >= 2)
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(*[words if n == 1 else bigrams for n in sizes])


def _blocks(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Neighbouring rows with about BLOCK tokens each."""
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(lists):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + BLOCK, side="right")), first + 1)
        yield lists.slice(first, last - first)
        first = last


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the number of it among the distinct ones, and those."""
    encoded = pa.array(values).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_numpy(zero_copy_only=False)


def _terms(
    lists: pa.ListArray, sizes: Sequence[int] | None, halves: tuple[pa.Array, pa.Array] | None = None
) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the term, distinct terms) of rows of terms, or with `sizes` of the n-grams that `ngrams` makes of
    rows of tokens; with `halves` only pairs of a first and a second word from the two lists."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    keep = pc.fill_null(pc.greater_equal(pc.utf8_length(flat), 2), False) if sizes else pc.is_valid(flat)
    rows, encoded = rows[keep.to_numpy(zero_copy_only=False)], flat.filter(keep).dictionary_encode()
    codes, names = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    if not sizes or 2 not in sizes:
        return rows, codes, names
    first, second, of = codes[:-1], codes[1:], rows[1:]
    chosen = rows[:-1] == of
    for place, half in zip((first, second), halves or ()):
        chosen = chosen & pc.is_in(names, value_set=half.cast(names.type)).to_numpy(zero_copy_only=False)[place]
    pair, pairs = _coded(first[chosen] * len(names) + second[chosen])
    left, right = (names.take(pa.array(x)) for x in (pairs // max(len(names), 1), pairs % max(len(names), 1)))
    bigrams = pc.binary_join_element_wise(left, right, pa.scalar(" ", names.type))
    if 1 in sizes:  # a token that reads like a pair is the same term
        rows, codes = np.concatenate([rows, of[chosen]]), np.concatenate([codes, len(names) + pair])
        whole = pa.concat_arrays([names, bigrams]).dictionary_encode()
        return rows, whole.indices.to_numpy(zero_copy_only=False)[codes].astype(np.int64), whole.dictionary
    return of[chosen], pair.astype(np.int64), bigrams


def word_counts(text: Column) -> Column:
    """Array of (term, tf): the distinct words of two and more characters of a text, in Arrow batches; null for a null text."""

    def counts(texts: pa.Array) -> pa.Array:
        lists = pc.utf8_split_whitespace(texts)
        blocks = []
        for block in _blocks(lists):
            rows, codes, names = _terms(block, (1,))
            pair, pairs = _coded(rows * max(len(names), 1) + codes)
            row, code = pairs // max(len(names), 1), pairs % max(len(names), 1)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(block))))
            items = pa.StructArray.from_arrays(
                [names.take(pa.array(code)).cast(pa.string()), pa.array(np.bincount(pair, minlength=len(pairs)))], ["term", "tf"])
            blocks.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pc.is_null(block)))
        empty = pa.array([], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))
        return pa.concat_arrays([empty, *blocks])

    return F.arrow_udf(counts, "array<struct<term:string,tf:bigint>>")(text)


def _counted(
    docs: DataFrame, terms: str, sizes: Sequence[int] | None, words: Sequence[str] | None = None
) -> DataFrame:
    """(term, cf, df); with `words` only pairs of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = None if words is None else (pa.array(words, pa.string()),) * 2
        for batch in batches:
            for lists in _blocks(batch.column(0)):
                rows, codes, names = _terms(lists, sizes, halves)
                _, places = _coded(rows * max(len(names), 1) + codes)
                yield pa.RecordBatch.from_pydict({
                    "term": names.cast(pa.string()), "cf": np.bincount(codes, minlength=len(names)),
                    "df": np.bincount(places % max(len(names), 1), minlength=len(names)),
                })

    found = docs.select(terms).mapInArrow(count, "term string, cf long, df long")
    return found.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _frequent(words: DataFrame, max_features: int, most_docs: float) -> list[str] | None:
    """Of counted words those of which a pair can still be among the `max_features` most frequent terms: a pair is no more
    frequent than its words, and so many words that may be terms leave no place for a rarer one. None if that parts
    little or a word holds a space, so that a pair may read like it."""
    if not words.where(F.col("term").contains(" ")).isEmpty():
        return None
    top = words.where(F.col("df") <= most_docs).orderBy(F.desc("cf")).limit(max_features)
    last = top.agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
    if last["n"] < max_features:
        return None
    found = words.where(F.col("cf") >= last["cf"]).select("term").limit(20 * max_features + 1).collect()
    return [r["term"] for r in found] if len(found) <= 20 * max_features else None


def vocabulary(
    docs: DataFrame, terms: str, max_features: int = MAX_FEATURES, max_df: float = MAX_DF,
    sizes: Sequence[int] | None = None,
) -> DataFrame:
    """(term, cf, df, idf) of the `max_features` most frequent terms that occur in at most a share
    `max_df` of the non-empty documents; equal frequencies in term order. With `sizes` the column holds tokens, and
    their n-grams are the terms: then words are counted first, and of the pairs only those that can get in (`_frequent`)."""
    has_terms = F.exists(F.col(terms), lambda t: F.length(t) >= 2) if sizes else F.size(terms) > 0
    n_docs = docs.where(has_terms).count()
    counted = None
    if sizes and set(sizes) == {1, 2}:
        words = cut_lineage(_counted(docs, terms, (1,)))
        frequent = _frequent(words, max_features, n_docs * max_df)
        if frequent is not None:
            counted = words.unionByName(_counted(docs, terms, (2,), frequent))
    if counted is None:
        counted = _counted(docs, terms, sizes)
    return (
        counted.where(F.col("df") <= n_docs * max_df)
        .orderBy(F.desc("cf"), "term").limit(max_features)
        .withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)
    )


def _halves(terms: Sequence[str]) -> tuple[pa.Array, pa.Array]:
    """All first and all second words of the terms that may be pairs."""
    parts = [t.split(" ") for t in terms]
    return tuple(pa.array(sorted(found), pa.string()) for found in (
        {" ".join(p[:i]) for p in parts for i in range(1, len(p))}, {" ".join(p[i:]) for p in parts for i in range(1, len(p))}))


def _weighed(
    column: pa.ListArray, known: pa.Array, idf: np.ndarray, halves: tuple[pa.Array, pa.Array], sizes: Sequence[int] | None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of rows, row, index, weight) of blocks of rows: the entries of their unit-length vectors, in order."""
    n = len(known)
    for lists in _blocks(column):
        rows, codes, names = _terms(lists, sizes, halves)
        place = pc.fill_null(pc.index_in(names.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
        place = place[codes].astype(np.int64) if len(codes) else codes
        entries, counts = np.unique((rows * n + place)[place >= 0], return_counts=True)
        row, index = entries // n, entries % n
        weight = counts * idf[index]
        yield len(lists), row, index, weight / np.sqrt(np.bincount(row, weight * weight, len(lists)))[row]


@dataclass
class TfidfModel:
    """Vocabulary and idf weights, at most `max_features` of each."""

    terms: list[str]
    idf: list[float]

    def transform(
        self, df: DataFrame, terms: str, output: str = "features", sizes: Sequence[int] | None = None
    ) -> DataFrame:
        """Add the unit-length sparse vector of every row (all zeros without a known term). With `sizes` the column
        holds tokens, and their n-grams are the terms."""
        if not self.terms:
            raise ValueError("the vocabulary is empty")
        words, idf = list(self.terms), np.array(self.idf)

        def vectors(column: pa.Array) -> pa.Array:
            lengths, at, x = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            for n, row, index, weight in _weighed(column, pa.array(words, pa.string()), idf, _halves(words), sizes):
                lengths.append(np.bincount(row, minlength=n))
                at.append(index.astype(np.int32))
                x.append(weight)
            ends = pa.array(np.cumsum(np.concatenate(lengths)), pa.int32())
            return pa.StructArray.from_arrays([
                pa.array(np.zeros(len(column)), pa.int8()), pa.array(np.full(len(column), len(words)), pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at))),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))),
            ], names=["type", "size", "indices", "values"])

        return df.withColumn(output, F.arrow_udf(vectors, VectorUDT())(F.col(terms)))

    def totals(self, df: DataFrame, terms: str, sizes: Sequence[int] | None = None) -> DataFrame:
        """(index, total): the sum of the weights that `transform` gives each term; a task adds up its rows first."""
        words, idf = list(self.terms), np.array(self.idf)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, known, halves = np.zeros(len(words)), pa.array(words, pa.string()), _halves(words)
            for batch in batches:
                for _, _, index, weight in _weighed(batch.column(0), known, idf, halves, sizes):
                    sums += np.bincount(index, weight, len(words))
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"index": pa.array(found, pa.int32()), "total": sums[found]})

        added = df.select(terms).mapInArrow(add_up, "index int, total double")
        return added.groupBy("index").agg(F.sum("total").alias("total"))

    def names(self, spark: SparkSession) -> DataFrame:
        """(index, term) of the vocabulary."""
        return spark.createDataFrame(list(enumerate(self.terms)), "index int, term string")


def fit(
    docs: DataFrame, terms: str, max_features: int = MAX_FEATURES, max_df: float = MAX_DF,
    sizes: Sequence[int] | None = None,
) -> TfidfModel:
    rows = vocabulary(docs, terms, max_features, max_df, sizes).select("term", "idf").collect()
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows])


def indices(vector: Column) -> Column:
    """Positions of a vector's entries, for sparse and dense vectors alike."""
    plain = F.unwrap_udt(vector)
    return F.coalesce(plain["indices"], F.sequence(F.lit(0), F.size(plain["values"]) - 1))


def values(vector: Column) -> Column:
    return F.unwrap_udt(vector)["values"]


def entries(df: DataFrame, keep: Sequence[str], vector: str = "features") -> DataFrame:
    """One row (…keep, index, weight) per entry of each vector."""
    pairs = F.arrays_zip(indices(F.col(vector)).alias("index"), values(F.col(vector)).alias("weight"))
    return df.select(*keep, F.inline(pairs)).where(F.col("weight") != 0)


def term_weights(df: DataFrame, keep: Sequence[str], model: TfidfModel, vector: str = "features") -> DataFrame:
    """The same with the term instead of its position. The vocabulary, at most `max_features` rows,
    is the broadcast side."""
    names = F.broadcast(model.names(df.sparkSession))
    return entries(df, keep, vector).join(names, "index").drop("index")


def corpus_term_scores(
    df: DataFrame, model: TfidfModel, boost, minimum: float = 0.0005, vector: str = "features",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Mean weight of each term over all rows (zeros count), boosted, at or above `minimum`. `totals` as the model's, if
    the vectors are not there."""
    n_rows = df.agg(F.count("*").alias("n"))
    if totals is None:
        totals = entries(df, [], vector).groupBy("index").agg(F.sum("weight").alias("total"))
    means = (
        totals
        .join(F.broadcast(model.names(df.sparkSession)), "index")
        .withColumn("tfidf_score", F.col("total") / n_rows.scalar())
    )
    scored = means.select(
        "term", "tfidf_score", boost(F.col("term"), F.col("tfidf_score")).alias("weighted_score")
    )
    return scored.where(F.col("weighted_score") >= minimum)
