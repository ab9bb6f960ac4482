"""Vector codes: product quantisation in integers, with distances by Walsh-Hadamard coefficients.

A vector becomes integers and is cut into equal parts; each part position has a codebook, and a part's code
is the number of its nearest entry. Parts and entries, padded with zeros to a power of two, are transformed
by the Walsh-Hadamard matrix, whose entries are 1 and -1: sums of squared differences of coefficients are
the squared distance times the number of coefficients, exactly and in integers. Coefficients are taken in
sequency order (by number of sign changes, so the ones that hold most of a smooth vector come first); a sum
over the first ones is a lower bound, and an entry whose bound is above the full distance of the most
promising entry is given up.

Codebooks are refined by scans of the table: each task adds up the parts of every entry and passes on one row
per entry, so a round shuffles tasks x entries small rows and the driver holds the codebooks only.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm.common import col, read, scratch
from resona.session import cut_lineage

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK = 1024  # parts compared at once
FIRST = 8  # coefficients before the first entries are given up; then as many again, and so on


def sequency(size: int) -> np.ndarray:
    """The rows of the transform below in the order of their sign changes."""
    rows = transformed(np.eye(size, dtype=np.int64), np.arange(size))
    return np.argsort((np.diff(np.sign(rows.T), axis=1) != 0).sum(axis=1), kind="stable")


def transformed(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, padded with zeros to len(order) values, in that order."""
    size = len(order)
    out = np.zeros((len(values), size), np.int64)
    out[:, :values.shape[1]] = values
    half = 1
    while half < size:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        out = out.reshape(len(values), size)
        half *= 2
    return out[:, order]


def padded(size: int) -> int:
    return 1 << max(size - 1, 0).bit_length()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower number, and the squared distance."""
    size = padded(parts.shape[1])
    order = sequency(size)
    found, distances = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    book = transformed(entries, order)
    for at in range(0, len(parts), BLOCK):
        block = slice(at, at + BLOCK)
        found[block], distances[block] = _nearest(transformed(parts[block], order), book)
    return found, distances // size


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for coefficients; distances times the number of coefficients."""
    lines, size = np.arange(len(x)), book.shape[1]
    sums = np.zeros((len(x), len(book)), np.int64)
    for j in range(min(FIRST, size)):
        step = x[:, j, None] - book[None, :, j]
        step *= step
        sums += step
    lead = sums.argmin(axis=1)
    best = ((x - book[lead]) ** 2).sum(axis=1)
    rows, entry = np.nonzero(sums <= best[:, None])
    sums = sums[rows, entry]
    for j in range(FIRST, size, FIRST):
        to = slice(j, j + FIRST)
        sums = sums + ((x[rows, to] - book[entry, to]) ** 2).sum(axis=1)
        starts = np.searchsorted(rows, lines)
        lead = entry[_first_least(rows, sums, starts)]
        best = np.minimum(best, ((x - book[lead]) ** 2).sum(axis=1))
        alive = sums <= best[rows]
        rows, entry, sums = rows[alive], entry[alive], sums[alive]
    place = _first_least(rows, sums, np.searchsorted(rows, lines))
    return entry[place], sums[place]


def _first_least(rows: np.ndarray, sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each row's least sum stands first; rows are sorted and each has one at least."""
    least = np.minimum.reduceat(sums, starts)
    places = np.flatnonzero(sums == least[rows])
    return places[np.searchsorted(rows[places], np.arange(len(starts)))]


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each vector, shorter ones padded with zeros to `width`."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.floor(SCALE * flat)
    return out


def cut(numbers: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(numbers, parts, axis=1)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    value = lambda x: x.cast("double")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    return vector.isNotNull() & ~odd


def _width(vectors: DataFrame, parts: int) -> int | None:
    """The length of the longest vector, rounded up to whole parts; None without vectors."""
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    row = vectors.agg(F.max(F.size("vector")).alias("size"), F.max(largest).alias("most")).first()
    if row["size"] is None:
        return None
    width = -(-row["size"] // parts) * parts
    if 2 * padded(width // parts) * (SCALE * (row["most"] or 0) + 1) >= 1 << 31:
        raise ValueError("components are so large that squared distances leave 64 bits")
    return width


def fit(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> list[np.ndarray]:
    """A codebook (entries x integers) for each part position.

    They start as the parts of the `entries` rows with the smallest ids: rows of one id by their components,
    null ids last. Each round assigns every part of every usable vector and replaces an entry by the
    floored mean of its parts; an entry without parts stays. Fewer vectors than entries give smaller
    codebooks, none give empty ones. Vectors of different lengths count as padded with zeros.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(col(vector))).select(col(vec_id).alias("id"), col(vector).alias("vector"))
    width = _width(kept, parts)
    if width is None:
        return [np.zeros((0, 0), np.int64)] * parts
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").toArrow()["vector"]
    books = cut(whole_numbers(first.combine_chunks(), width), parts)
    size = width // parts
    fields = ["n", *[f"s{i}" for i in range(size)]]
    schema = ", ".join(["part int", "entry int", *[f"{f} long" for f in fields]])
    kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), *[(f, pa.int64()) for f in fields]])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            totals = np.zeros((parts, len(books[0]), 1 + size), np.int64)
            for batch in batches:
                for part, own in enumerate(cut(whole_numbers(batch.column(0), width), parts)):
                    entry, _ = nearest(own, books[part])
                    np.add.at(totals[part], entry, np.concatenate([np.ones((len(own), 1), np.int64), own], axis=1))
            part, entry = np.nonzero(totals[:, :, 0])
            columns = [part.astype(np.int32), entry.astype(np.int32), *totals[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=kind)

        sums = kept.select("vector").mapInArrow(add_up, schema)
        totals = sums.groupBy("part", "entry").agg(*[F.sum(f).alias(f) for f in fields])
        books = [book.copy() for book in books]
        for row in totals.collect():  # parts * entries rows at most
            part, entry, n, *total = row
            books[part][entry] = [x // n for x in total]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector, with `code` (the number of the nearest entry of each part as two hex
    digits) and `error` (the squared distances summed over the parts). Columns of these names are replaced, others stay.
    Rows with a null vector, or with null or non-finite components, are left out; repeated rows stay.
    """
    spark = vectors.sparkSession
    names = [c for c in vectors.columns if c.lower() not in ("code", "error")]
    (both,) = scratch(vectors, "coded")
    width = sum(book.shape[1] for book in books)
    shared = spark.sparkContext.broadcast(books)

    @F.arrow_udf("struct<code: string, error: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digits = np.array([f"{i:02x}" for i in range(max(map(len, shared.value), default=0))], object)
        for batch in batches:
            code, error = np.full(len(batch), "", object), np.zeros(len(batch), np.int64)
            for part, book in zip(cut(whole_numbers(batch, width), len(books)), shared.value):
                entry, distance = nearest(part, book)
                code, error = code + digits[entry], error + distance
            yield pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(error)], ["code", "error"])

    kept = vectors.where(usable(col(vector)))
    coded = kept.withColumn(both, run(col(vector)))
    return coded.select(*map(col, names), col(both)["code"].alias("code"), col(both)["error"].alias("error"))


def digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows with that label, nulls being one label) and
    codebooks_sha256, one row per usable row; see `fit` and `encode` for nulls, ties, repeated rows and
    lengths. Very long vectors only cost time; an empty table gives an empty result."""
    books = fit(vectors, vec_id, vector, **sizes)
    chosen = vectors.select(col(vec_id).alias("vec_id"), col(vector).alias("vector"), col(label).alias("label"))
    coded = cut_lineage(encode(chosen, books, "vector").drop("vector"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """SQL of one round: the assignment by codebook b{i}, and the codebook after it."""
    return f"""
a{i} AS MATERIALIZED (
    SELECT r, p, v, min({{'d': vv + ee - 2 * list_dot_product(v, e), 'k': k}}) AS m
    FROM parts JOIN b{i} USING (p) GROUP BY r, p, v),
s{i} AS (
    SELECT p, m.k AS k, i, floor(sum(v[i]) / count(*)) AS x
    FROM a{i}, range(1, len(v) + 1) AS t(i) GROUP BY ALL),
n{i} AS (SELECT p, k, list(x ORDER BY i) AS e FROM s{i} GROUP BY p, k),
b{i + 1} AS MATERIALIZED (
    SELECT p, k, coalesce(n.e, b.e) AS e, list_dot_product(coalesce(n.e, b.e), coalesce(n.e, b.e)) AS ee
    FROM b{i} b LEFT JOIN n{i} n USING (p, k))"""


SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v,
           row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT r, p, v, list_dot_product(v, v) AS vv FROM (
        SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM kept, range(4) AS t(p))),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v AS e, vv AS ee FROM parts WHERE r <= 256),
{",".join(_round(i) for i in range(ROUNDS))},
a4 AS MATERIALIZED (
    SELECT r, p, min({{'d': vv + ee - 2 * list_dot_product(v, e), 'k': k}}) AS m
    FROM parts JOIN b4 USING (p) GROUP BY r, p, v),
coded AS (
    SELECT r, string_agg(lower(printf('%02x', m.k)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
    FROM a4 GROUP BY r),
digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ',' ORDER BY p, k)) AS h
    FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""
