"""k-means for many numbers of clusters and many starts at once.

All models (k, start) move together: a scan of the points finds for every model the nearest centre of each
point and adds the points up per centre within the task; what tasks pass on is one vector per centre, merged by
Spark. So a step of 50 models costs one scan, and neither the driver nor a task holds more than all centres.

Starts are k-means++ draws: a point is drawn with a probability in proportion to its weight and its squared
distance to the centres drawn before. The draw is a race: each point gets the exponential time -ln(u) / (weight *
distance) with u from a hash of its key, and the least time wins, so it is one minimum over the table, the same at
every partitioning. The first k draws of a start are the start of every smaller k, so all k share them.
"""

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.operators import tfidf

RESTARTS = 10
MAX_ITER = 20
PRIME = 2_147_483_647  # of the hash: u = ((h * a + b) mod PRIME + 1) / (PRIME + 1)
DIGITS = 9  # distances are compared to so many places, so that the order of a sum decides nothing
CELLS = 2_000_000  # of the dense block of points a task compares at once


def multipliers(start: int, draw: int, seed: int) -> tuple[int, int]:
    """(a, b) of the hash for one draw of one start."""
    a = (48271 * (seed + 7919 * start + 104729 * draw + 1)) % (PRIME - 1) + 1
    return a, (69621 * (seed + 15485863 * (start + 1) + 32452843 * (draw + 1))) % PRIME


@dataclass
class Clusters:
    """One fitted model: centres (k or fewer rows), the cost of the points, weight and number of points per cluster."""

    centres: np.ndarray
    cost: float
    sizes: np.ndarray
    sums: np.ndarray = field(repr=False)  # weighted sum of each cluster's points
    squares: np.ndarray = field(repr=False)  # weighted sum of their squared lengths


def points(df: DataFrame, key: str, features: str = "features", weight: str | None = None) -> DataFrame:
    """(h, w, at, x): the hash of each row's key, its weight, and its vector's entries."""
    digits = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 13)
    return df.select(
        (F.conv(digits, 16, 10).cast("long") % PRIME).alias("h"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        tfidf.indices(F.col(features)).alias("at"), tfidf.values(F.col(features)).alias("x"),
    )


def _dense(at: pa.ListArray, x: pa.ListArray, size: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
    dense = np.zeros((len(at), size))
    dense[rows, at.flatten().to_numpy(zero_copy_only=False)] = x.flatten().to_numpy(zero_copy_only=False)
    return dense


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, w, dense rows) of bounded blocks."""
    most = max(1, CELLS // max(1, size))
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            h, w, at, x = batch.slice(first, most).columns
            yield h.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False), _dense(at, x, size)


def nearest(features: Column, centres: np.ndarray) -> Column:
    """The number of the nearest centre of each vector, in place; the lowest wins a tie."""
    size = centres.shape[1]
    most = max(1, CELLS // max(1, size))

    def number(at: pa.Array, x: pa.Array) -> pa.Array:
        found = [
            _distances(_dense(at.slice(i, most), x.slice(i, most), size), centres).argmin(axis=1) for i in range(0, len(at), most)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int32())

    return F.arrow_udf(number, "int")(tfidf.indices(features), tfidf.values(features))


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    product = rows @ centres.T
    squares = (rows ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)[None, :]
    return np.round(np.maximum(squares - 2 * product, 0), DIGITS)


def _dimensions(found: DataFrame) -> int:
    return (found.agg(F.max(F.array_max("at"))).first()[0] or 0) + 1


def draw(found: DataFrame, size: int, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """For each start the first k points drawn (fewer where no point is off them)."""
    spark = found.sparkSession
    starts = [np.zeros((0, size)) for _ in range(restarts)]
    for step in range(k):
        shared = spark.sparkContext.broadcast(starts)

        def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            drawn = [i for i, centres in enumerate(shared.value) if len(centres) == step]
            known = np.vstack([shared.value[i] for i in drawn]) if step and drawn else None
            for h, w, rows in _blocks(batches, size):
                near = None if known is None else _distances(rows, known).reshape(len(rows), len(drawn), step).min(axis=2)
                for place, start in enumerate(drawn):
                    a, b = multipliers(start, step, seed)
                    u = ((h * a + b) % PRIME + 1) / (PRIME + 1)
                    rate = w * (1.0 if near is None else near[:, place])
                    with np.errstate(divide="ignore"):
                        time = np.where(rate > 0, -np.log(u) / rate, math.inf)
                    i = int(time.argmin())
                    if time[i] < math.inf and (start not in best or time[i] < best[start][0]):
                        best[start] = (time[i], rows[i].copy())
            yield pa.RecordBatch.from_pydict({
                "start": pa.array(list(best), pa.int32()),
                "time": pa.array([t for t, _ in best.values()], pa.float64()),
                "point": pa.array([p.tolist() for _, p in best.values()], pa.list_(pa.float64())),
            })

        raced = found.mapInArrow(race, "start int, time double, point array<double>")
        for row in raced.groupBy("start").agg(F.min_by("point", "time").alias("point")).collect():  # one row per start
            starts[row["start"]] = np.vstack([starts[row["start"]], row["point"]])
    return starts


def _add_up(found: DataFrame, models: Sequence[np.ndarray], size: int) -> list[dict[str, np.ndarray]]:
    """For each model what its centres attract: weighted sums, weights, costs and squared lengths."""
    spark = found.sparkSession
    ends = np.cumsum([0, *[len(m) for m in models]])
    shared = spark.sparkContext.broadcast((np.vstack(models), ends))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, ends = shared.value
        totals = np.zeros((len(centres), size + 3))
        for _, w, rows in _blocks(batches, size):
            distances, lines = _distances(rows, centres), np.arange(len(rows))
            held = np.zeros((len(rows), len(centres)))
            for a, b in zip(ends, ends[1:]):
                if b > a:
                    held[lines, a + distances[:, a:b].argmin(axis=1)] = w
            squares = (rows ** 2).sum(axis=1)
            totals[:, :size] += held.T @ rows
            totals[:, size] += held.sum(axis=0)
            totals[:, size + 1] += (held * distances).sum(axis=0)
            totals[:, size + 2] += held.T @ squares
        slots = np.flatnonzero(totals[:, size])
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(slots, pa.int32()),
            "total": pa.array([totals[i].tolist() for i in slots], pa.list_(pa.float64())),
        })

    scanned = found.mapInArrow(scan, "slot int, total array<double>").withColumn("total", array_to_vector("total"))
    merged = np.zeros((int(ends[-1]), size + 3))
    sums = scanned.groupBy("slot").agg(vector_to_array(Summarizer.sum(F.col("total"))).alias("total"))
    for row in sums.collect():  # one row per centre
        merged[row["slot"]] = row["total"]
    return [
        {"sums": m[:, :size], "weights": m[:, size], "costs": m[:, size + 1], "squares": m[:, size + 2]}
        for m in (merged[a:b] for a, b in zip(ends, ends[1:]))
    ]


def fit_all(
    found: DataFrame, ks: Sequence[int], restarts: int = RESTARTS, seed: int = 0, max_iter: int = MAX_ITER,
) -> dict[tuple[int, int], Clusters]:
    """Every model (k, start) over `points`, after at most `max_iter` steps of all of them; a centre without points
    stays. `found` is read once per draw and step and should be a stored table."""
    if not ks:
        return {}
    size = _dimensions(found)
    starts = draw(found, size, max(ks), restarts, seed)
    models = {(k, r): starts[r][:k] for k in ks for r in range(restarts)}
    moving = [name for name, centres in models.items() if len(centres)]
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for name, total in zip(moving, _add_up(found, [models[name] for name in moving], size)):
            old, weights = models[name], total["weights"][:, None]
            models[name] = np.where(weights > 0, total["sums"] / np.where(weights > 0, weights, 1), old)
            if np.abs(models[name] - old).max() > 1e-12:
                still.append(name)
        moving = still  # a model that stands still is not scanned again
    last = _add_up(found, list(models.values()), size)
    return {
        name: Clusters(centres, float(t["costs"].sum()), t["weights"], t["sums"], t["squares"])
        for (name, centres), t in zip(models.items(), last)
    }


def best_per_k(models: dict[tuple[int, int], Clusters]) -> dict[int, Clusters]:
    """For each k the start of the least cost, the first of equal ones."""
    found: dict[int, Clusters] = {}
    for (k, _), model in sorted(models.items()):
        if k not in found or round(model.cost, 6) < round(found[k].cost, 6):
            found[k] = model
    return found


def silhouettes(found: DataFrame, models: dict[int, Clusters]) -> dict[int, float]:
    """Mean silhouette of each model over all points by weight, with squared Euclidean distances, in one scan: that
    distance needs sums per cluster only. -1 for fewer than two clusters with points."""
    scores = {k: -1.0 for k, m in models.items() if (m.sizes > 0).sum() < 2}
    judged = {k: m for k, m in models.items() if k not in scores}
    if not judged:
        return scores
    size = next(iter(judged.values())).centres.shape[1]
    shared = found.sparkSession.sparkContext.broadcast(judged)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(2) for k in shared.value}
        for _, w, rows in _blocks(batches, size):
            lines, squares = np.arange(len(rows)), (rows ** 2).sum(axis=1)[:, None]
            for k, model in shared.value.items():
                own = _distances(rows, model.centres).argmin(axis=1)
                held = np.where(model.sizes > 0, model.sizes, 1)
                mean = squares + (model.squares / held)[None] - 2 * rows @ (model.sums / held[:, None]).T
                mean = np.maximum(mean, 0)
                n = model.sizes[own]
                inner = mean[lines, own] * n / np.where(n > 1, n - 1, 1)
                mean[:, model.sizes == 0] = math.inf
                mean[lines, own] = math.inf
                outer = mean.min(axis=1)
                most = np.maximum(inner, outer)
                value = np.where((n > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0)
                totals[k] += [(w * value).sum(), w.sum()]
        yield pa.RecordBatch.from_pydict({
            "k": pa.array(list(totals), pa.int32()),
            "total": pa.array([t[0] for t in totals.values()], pa.float64()),
            "weight": pa.array([t[1] for t in totals.values()], pa.float64()),
        })

    scanned = found.mapInArrow(scan, "k int, total double, weight double")
    rows = scanned.groupBy("k").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect()
    return scores | {r["k"]: r["total"] / r["weight"] for r in rows}
