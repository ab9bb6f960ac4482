"""Join of a large table to a per-key table when few keys may hold most of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.session import cut_lineage

ROWS_PER_TASK = 5_000_000


def key_histogram(facts: DataFrame, key: str) -> DataFrame:
    """(key, n): how many rows each key has, null among them. The pass reads the key column only and counts before it
    shuffles. Store it (`cut_lineage`) where several joins of one table use it."""
    return facts.groupBy(key).agg(F.count("*").alias("n"))


def hot_keys(histogram: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, _spread): every key with more rows than one task should take, and over how many tasks to spread it.
    Of N rows there are fewer than N / rows_per_task such keys."""
    spread = F.ceil(F.col("n") / rows_per_task).cast("long").alias("_spread")
    return histogram.where((F.col("n") > rows_per_task) & F.col(key).isNotNull()).select(key, spread)


def salted_join(
    facts: DataFrame,
    per_key: DataFrame,
    key: str,
    row_id: str,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """`facts` join `per_key` on `key`, with the rows of every hot key spread by a hash of `row_id`.

    The `per_key` rows of a hot key are copied once per spread slot, and its rows in `facts` meet one of the copies;
    all other keys join as usual. Rows without a key match nothing; each gets a slot of its own, so they are spread
    over all tasks. The result equals a plain join for every input. Nothing runs while the plan is made: the hot keys
    are part of it, from `histogram` if it is given, else counted on the way. They are broadcast, which is bounded:
    fewer than one row per `rows_per_task` rows of `facts` (200,000 for 10^12 rows).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if histogram is None:
        histogram = key_histogram(facts, key)
    hot = F.broadcast(hot_keys(histogram, key, rows_per_task))
    spread, place = F.coalesce(F.col("_spread"), F.lit(1)), F.xxhash64(row_id)
    slot = F.when(F.col(key).isNull(), place).otherwise(F.pmod(place, spread))
    left = facts.join(hot, key, "left").withColumn("_slot", slot).drop("_spread")
    right = (
        per_key.join(hot, key, "left")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)))
        .drop("_spread")
    )
    return left.join(right, [key, "_slot"], how).drop("_slot")


def broadcast_checked(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Compute a small frame once, store it, and broadcast it if it has at most `max_rows` rows; a
    larger one is joined the way Spark chooses."""
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored
