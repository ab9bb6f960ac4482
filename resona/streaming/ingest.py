"""Landed thread pages as a stream: flatten and score the text of each comment as it arrives.

These stages look at one row at a time, so they need no state and no watermark. Relevance, product
category and resonance score need the whole table and stay with the batch job.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from resona.operators.relevance import preprocess_comments
from resona.plans.score import score_text
from resona.sources.schemas import THREAD_PAGE
from resona.sources.threads import flatten_threads


def read_thread_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(THREAD_PAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def score_stream(pages: DataFrame) -> DataFrame:
    return score_text(preprocess_comments(flatten_threads(pages)))


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once; both folders must be shared by all executors."""
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
