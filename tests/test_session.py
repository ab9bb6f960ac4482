import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from resona.session import cut_lineage, discard


def shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum("shuffle_" in blocks.apply(i).name() for i in range(blocks.size()))


def test_shuffle_files_go_once_the_table_is_stored(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = cut_lineage(counted.join(counted.withColumnRenamed("count", "n"), "k"))
    assert shuffle_files(spark) <= before
    assert spark.conf.get(key, None) == setting
    assert stored.agg(F.sum("n")).first()[0] == 1000


def test_discarded_tables_leave_no_files(spark):
    stored = cut_lineage(spark.range(10))
    folder = os.path.dirname(urlparse(stored.inputFiles()[0]).path)
    assert stored.count() == 10 and os.path.isdir(folder)
    discard(stored)
    assert not os.path.exists(folder)


def test_small_tables_of_heavy_passes_are_kept_once(spark):
    stored = cut_lineage(spark.range(100, numPartitions=1), heavy=True)
    assert stored.count() == 100 and stored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
