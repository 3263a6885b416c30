"""What the operators of this subpackage share: table access, columns by place, checkpoints, joins with hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at together.
SLICE_BYTES = 8 << 20


#: Rows in one Arrow batch.  The default of 10,000 holds tens of megabytes of text, several times over, in each task.
BATCH_ROWS = 2000

#: Rows of one key that a task of a join takes; keys with more are dealt to several tasks.
ROWS_PER_KEY = 1 << 16
#: Keys that are dealt to several tasks, at most: each holds more than one in HOT_KEYS of all rows.
HOT_KEYS = 10_000
#: Bits of a broadcast bitmap, at most (64 MB).
MOST_BITS = 1 << 29


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict[str, Callable[[], object]] = {}


def hold(name: str, drop: Callable[[], object]) -> None:
    """In a worker: `name` keeps tables from task to task, which drop() lets go of.  What other operators have kept goes now, also tables that refer to themselves."""
    others = [k for k in _held if k != name]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    _held[name] = drop


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place, so that no name of theirs can clash with another or be ambiguous."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> Column:
    """The column of numbered(df) that df calls `name`: exactly so, or else the only one that differs in case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found or (not exact and len(found) > 1):
        raise ValueError(f"no column {name!r} among {df.columns}")
    return F.col(f"c{found[0]}")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the names given; all other columns, whatever they are called, are not looked at."""
    return numbered(df).select(*[place(df, name).alias(alias) for alias, name in wanted.items()])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.  Only a local session, as in tests, makes its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is not None or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, cutting its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """checkpoint(df), and the measures taken while it is written.  A stage that runs again counts again, so that counts are upper bounds."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, *[c.alias(k) for k, c in measures.items()]).checkpoint(eager=True)
    got = seen.get
    return out, {k: got.get(k) or 0 for k in measures}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def blocks_of(rows: DataFrame, key: str, text_col: str, block_bytes: int) -> Iterator[DataFrame]:
    """rows in blocks of about `block_bytes` of text, all rows of a key in one block.  Each block can be read apart from the others.

    One block is rows themselves.  More are written, sorted by block, to the checkpoint folder's store once, a folder for each, and read from there.
    """
    blocks = -(-text_bytes(rows, text_col) // block_bytes)
    if blocks <= 1:
        yield rows
        return
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    dealt.repartition(max(1, min(blocks, shuffle_partitions(spark))), "__block").write.partitionBy("__block").parquet(path)
    for b in range(blocks):
        part = spark.read.schema(dealt.schema).parquet(path).filter(F.col("__block") == b).drop("__block")
        yield part
    remove(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int, counts: DataFrame | None = None, salt: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """left joined with right on `keys`, where a key may hold most of left's rows but few of right's.

    `rows` is the number of rows of left, or a bound of it; `counts` has the keys with their number of rows `n`, if that is known; `salt` names the columns of
    left that deal rows of a hot key (all, if none are named).  A key with more than max(ROWS_PER_KEY, rows / HOT_KEYS) rows is dealt to as many tasks as that number
    fits into its rows, and its rows of right are copied to each; there are HOT_KEYS such keys at most, which bounds what is broadcast.
    """
    keys = list(keys)
    limit = max(ROWS_PER_KEY, rows // HOT_KEYS)
    if rows <= limit:
        return left.join(right, keys, how)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("n"))
    parts, seen = measured(counts.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__parts")), n=F.count(F.lit(1)))
    if not seen["n"]:
        return left.join(right, keys, how)
    hot = F.broadcast(parts.limit(2 * HOT_KEYS).toDF(*[f"__hot{i}" for i in range(len(keys))], "__parts"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__hot{i}") for i, k in enumerate(keys)])
    gone = [f"__hot{i}" for i in range(len(keys))] + ["__parts"]
    deal = F.pmod(F.xxhash64(*(salt or left.columns)), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = left.join(hot, same, "left").withColumn("__salt", deal).drop(*gone)
    copied = right.join(hot, same, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop(*gone)
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, n: int | None = None) -> DataFrame:
    """rows with a flag `__among`: false only if the key is surely not in ids (one column, checkpointed by the caller; n of them, if known).

    The bitmap has about 32 bits for each id, and MOST_BITS (64 MB) at most; that is all that is broadcast.  With more than a hundred million ids it lets
    through more and more keys that are not among them, which costs the caller work but no result.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (32 * (ids.count() if n is None else n)).bit_length()))
    spot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    spot = ids.select(spot_of(F.col(ids.columns[0])).alias("p"))
    maps = spot.groupBy(F.bitmap_bucket_number("p").alias("__no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    bit: Column = F.bitmap_bit_position(spot_of(F.col(key)))
    byte = F.conv(F.hex(F.substring("__map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(spot_of(F.col(key))) == F.col("__no"), "left")
    return joined.withColumn("__among", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("__no", "__map")


def without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose `key` (over numbered(docs)) is in `dropped` (one column).

    Only rows that may be among the dropped ones are shuffled, the others stay where they are.
    """
    gone, seen = measured(dropped.toDF("__gone").distinct(), n=F.count(F.lit(1)))
    rows = numbered(docs)
    flagged = maybe_among(rows.withColumn("__key", key), "__key", gone, seen["n"])
    unsure = flagged.filter("__among").join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    return flagged.filter(~F.col("__among")).select(*rows.columns).unionByName(unsure.select(*rows.columns)).toDF(*docs.columns)
