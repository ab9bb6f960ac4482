"""What the operators share: reading tables, bounded Arrow batches, connected components."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.session import cut_lineage

BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str) -> Column:
    """An id as text, to pass it through pandas: there, a column of longs with a null becomes doubles."""
    return col(name).cast("string")


def as_id(name: str) -> Column:
    return col(name).cast("long")


def scratch(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, whatever the case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


@contextmanager
def short_plan_texts(spark: SparkSession, most: int = 20_000) -> Iterator[None]:
    """While it lasts, the printed plans that Spark keeps of each query end after `most` characters: one with a large
    literal would be held several times over by the driver. A smaller setting of the session stays."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key, None)
    if before is None or not before.isdigit() or int(before) > most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers at most BATCH_ROWS rows at once: texts are long, and a batch is held whole.
    A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (a, b), for nodes with an edge.

    Minimum labels travel along edges, then each label jumps to its own label; both halve the distance
    left, so a few rounds do. Every round is stored, so nothing is recomputed when an executor is lost,
    and each join has stored tables on both sides, so that a hot label can be split. Nulls are not edges.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a != b")
    links = cut_lineage(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(
        links.groupBy(F.col("a").alias("node"))
        .agg(F.least(F.first("a"), F.min("b")).alias("label"))
    )
    while True:
        near = (
            links.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        step = cut_lineage(labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        ))
        target = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut_lineage(step.join(target, "label").select("node", "old", F.col("next").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("old != label").isEmpty():
            return labels.withColumnRenamed("label", "root")
