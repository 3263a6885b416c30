"""Mention facts kept up to date by Structured Streaming.

New block files are read as they arrive; each micro-batch adds its facts to a table partitioned by batch, so a batch that
is repeated after a failure replaces its own partition and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import mentions


def read_blocks(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def maintain(blocks: DataFrame, aliases: DataFrame, keys: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the facts of new blocks; with available-now trigger it ends when all files are read."""

    def add(batch: DataFrame, batch_id: int) -> None:
        facts = mentions(batch, aliases, keys).withColumn("batch", F.lit(batch_id))
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return blocks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The facts of all batches so far."""
    return spark.read.parquet(out).groupBy(*keys, "name").agg(F.sum("n").cast("long").alias("n"))
