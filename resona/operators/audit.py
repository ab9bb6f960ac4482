"""Audits of what a database would enforce: keys, references, the catalogue, logged SQL texts."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from resona.functions.guard import VALID, sql_reason


def pk_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat or have a null part, with their number of rows."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | has_null)


def fk_audit(
    references: Sequence[tuple[str, DataFrame, str, DataFrame, str]],
) -> DataFrame:
    """Child keys without a parent: (constraint, key, n_rows) over all given references.

    Each reference is (name, child, child column, parent, parent column). Child rows are counted per
    key before the anti join, so a key with very many rows is one row there. Whole numbers of one type are counted and
    joined as they are, which holds much less memory than their digits; other keys as text.
    """
    parts = []
    for name, child, column, parent, parent_column in references:
        kinds = {df.schema[c].dataType for df, c in ((child, column), (parent, parent_column))}
        kind = kinds.pop() if len(kinds) == 1 else StringType()
        kind = kind if isinstance(kind, IntegralType) else StringType()
        used = child.select(F.col(column).cast(kind).alias("key")).where("key IS NOT NULL")
        counted = used.groupBy("key").agg(F.count("*").alias("n_rows"))
        known = parent.select(F.col(parent_column).cast(kind).alias("key"))
        parts.append(
            counted.join(known, "key", "left_anti")
            .select(F.lit(name).alias("constraint_name"), F.col("key").cast("string").alias("key"), "n_rows")
        )
    return reduce(DataFrame.unionByName, parts)


def catalog_describe(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    references: Sequence[tuple[str, str, str, str]],
    descriptions: dict[str, str],
) -> DataFrame:
    """One row per column: table, position, column, type, what it refers to, table description, and
    the table's exact number of rows."""
    columns = spark.createDataFrame(
        [(name, i, f.name, f.dataType.simpleString())
         for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)],
        "table_name string, position int, column_name string, data_type string",
    )
    refers = spark.createDataFrame(
        [(t, c, f"FOREIGN KEY ({c}) REFERENCES {pt}({pc})") for t, c, pt, pc in references],
        "table_name string, column_name string, relationship string",
    )
    about = spark.createDataFrame(list(descriptions.items()), "table_name string, description string")
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ])
    return (
        columns.join(refers, ["table_name", "column_name"], "left")
        .join(about, "table_name", "left").join(counts, "table_name")
    )


def sql_log_audit(log: DataFrame, text: str = "query_text") -> DataFrame:
    """Add `valid` and `reason` to a table of SQL texts."""
    judged = log.withColumn("reason", sql_reason(F.col(text)))
    return judged.withColumn("valid", F.col("reason") == VALID)
