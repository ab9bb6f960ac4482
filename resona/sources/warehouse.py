"""Reading warehouse tables: column scans, counts, ad-hoc SELECTs, previews."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions.guard import check_sql

def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that comes in fewer pieces than there are cores.

    For tables that feed heavy text work. A large table has more splits than cores and stays as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns of a table; the parquet reader then reads just these."""
    return df.select(*columns)


def exact_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def adhoc_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run a SELECT on the given tables once the guard has accepted it."""
    valid, reason = check_sql(spark, text)
    if not valid:
        raise ValueError(reason)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in a fixed order, each with the row count of the whole table."""
    total = df.agg(F.count("*").alias("n"))
    return df.orderBy(*order).limit(n).withColumn("row_count", total.scalar())
