"""Cutting lineage in the shared folder that the session names, and joins whose keys may hold very many rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task takes; a key with more, and more than one in HOT_KEYS of all rows, is dealt to several tasks.
ROWS_PER_KEY, HOT_KEYS = 1 << 16, 10_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Write to the shared folder of spark.checkpoint.dir and read back; only a local session without one, as in tests, makes its own."""
    spark: SparkSession = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def hot_keys(counts: DataFrame, key: str, rows: int, rows_per_key: int = ROWS_PER_KEY) -> DataFrame | None:
    """The keys of `counts` (key, n) that are dealt to several tasks, and how many; None if there are none.  There are HOT_KEYS at most."""
    limit = max(rows_per_key, rows // HOT_KEYS)
    if rows <= limit:
        return None
    found = counts.filter(F.col("n") > limit).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    few = found.limit(2 * HOT_KEYS).collect()
    return F.broadcast(counts.sparkSession.createDataFrame(few, found.schema)) if few else None


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """left joined with right on `key`, where one key may hold most of left's rows and few of right's: rows of the keys in `hot` are dealt to several tasks."""
    if hot is None:
        return left.join(right, key)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__deal", F.pmod(F.xxhash64(*left.columns), parts).cast("int"))
    copied = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__hot", "__parts").join(copied.drop("__hot", "__parts"), [key, "__deal"]).drop("__deal")
