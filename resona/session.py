"""Session settings and the shared folder for checkpoints and written tables."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own. RESONA_DRIVER_MEMORY sets the heap."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("resona")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RESONA_DRIVER_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


@cache
def _local_dir() -> tempfile.TemporaryDirectory:
    """Removed when the interpreter ends."""
    return tempfile.TemporaryDirectory(prefix="resona-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a temporary one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        current = _local_dir().name
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table to write."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the shuffle files of a query go as soon as it has ended. Else they stay on the executors' disks
    until the driver happens to collect its garbage, those of all earlier steps of a long job at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame, heavy: bool = False) -> DataFrame:
    """Store a frame that several later jobs read, as a Parquet table in the shared folder.

    The table survives lost executors, and later passes read only the columns they need. With `heavy`
    later passes, a frame that came out in fewer parts than there are cores (so a small one) is
    stored once more in as many parts as cores. What was shuffled for it goes once it is stored; the table itself
    stays until `discard`.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism

    def stored(frame: DataFrame) -> DataFrame:
        path = new_path(spark, "stage")
        with own_shuffles_dropped(spark):
            frame.write.option("compression", "zstd").parquet(path)
        found = spark.read.schema(df.schema).parquet(path)
        found._stored_at = path
        return found

    table = stored(df)
    if heavy and table.rdd.getNumPartitions() < cores:
        few, table = table, stored(table.repartition(cores))
        discard(few)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from `cut_lineage` that nothing reads any more, neither they nor a frame made of them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(vars(table)["_stored_at"])
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
