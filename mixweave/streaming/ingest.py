"""Taking in new shards as they arrive; beyond the batch pipeline, which has no streams.

Tokens are counted on the way and running totals are kept per domain; files already taken in are
remembered by the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import char_count, tokens_from_chars


def stream_documents(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return docs.withColumn("tokens", tokens_from_chars(char_count(F.col("text"))))


def ingest(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append documents to a parquet table, all that is there now and then stop."""
    return docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_tokens(docs: DataFrame, domain: str) -> DataFrame:
    return docs.groupBy(domain).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
