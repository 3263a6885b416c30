"""Readers and writers: corpus and edition files, dictionaries, keyed tables; the document tables as chapters and blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import checkpoint

BLOCK = "id BIGINT, kind STRING, text STRING, page INT, editions ARRAY<STRING>, atype STRING, ink STRING"
CORPUS = f"meta STRING, chapters ARRAY<STRUCT<no: INT, title: STRING, blocks: ARRAY<STRUCT<{BLOCK.replace(' BIGINT', ': BIGINT').replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' ARRAY', ': ARRAY')}>>>>"
EDITION = "chapters MAP<STRING, STRUCT<title: STRING, text: STRING, annos: ARRAY<STRUCT<editions: ARRAY<STRING>, atype: STRING, text: STRING>>>>"
# The kinds of blocks.
MAIN, ANNOTATION, NOTE = "正文", "批语", "校记"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Block table and chapter table of corpus files {meta, chapters: [{no, title, blocks: [...]}]}."""
    raw = spark.read.schema(CORPUS).json(path, multiLine=True)
    chapters = raw.select(F.explode("chapters").alias("c")).select(F.col("c.no").alias("chapter"), "c.title", "c.blocks")
    blocks = chapters.select("chapter", F.explode("blocks").alias("b")).select("chapter", "b.*")
    titles = chapters.select("chapter", "title")
    return blocks, titles.join(chapter_rollup(blocks), "chapter", "left")


def chapter_rollup(blocks: DataFrame, keys: Sequence[str] = ("chapter",), kind: str = "kind", page: str = "page") -> DataFrame:
    count = lambda k: F.count(F.when(F.col(kind) == k, 1))
    return blocks.groupBy(*keys).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), count(MAIN).alias("n_main"), count(ANNOTATION).alias("n_anno"), count(NOTE).alias("n_note"))


def read_dictionary(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """Rows of a separated text file; `#` comments and blank lines skipped, short rows padded with ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep=sep, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    return rows.na.fill("").filter(F.concat(*columns) != "")


def explode_multivalue(df: DataFrame, col: str, sep: str = r"[,，、]", skip: Sequence[str] = ("—", ""), extra: DataFrame | None = None) -> DataFrame:
    """One row per value of a list in a string; rows of an extra table come in without duplicates."""
    out = df.withColumn(col, F.explode(F.split(F.col(col), sep))).withColumn(col, F.trim(col)).filter(~F.col(col).isin(list(skip)))
    return out if extra is None else out.unionByName(extra.select(*out.columns)).dropDuplicates()


def read_edition(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """stream, chapter, title, text, annos of edition files {chapters: {number: {...}}}."""
    raw = spark.read.schema(EDITION).json(path, multiLine=True)
    return raw.select(F.explode("chapters").alias("no", "c")).select(F.lit(stream).alias("stream"), F.col("no").cast("int").alias("chapter"), "c.title", "c.text", "c.annos")


def pending(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `wanted` whose keys are not stored yet."""
    return wanted.join(stored.select(*keys), list(keys), "left_anti")


#: Chapter digests that go to the hash of their edition together.
DIGESTS = 256


def _hashed_in_order(n_keys: int):
    """Rows (keys, no, chapters, chars, d) in order of keys and no to one row a key: the sums, and the digest of all d, one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, columns, chapters, chars, digest = None, [], 0, None, None

        def whole() -> pa.RecordBatch:
            sums = [pa.array([chapters], pa.int64()), pa.array([chars], pa.int64()), pa.array([digest and digest.hexdigest()], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *sums], names=[*[f"k{i}" for i in range(n_keys)], "chapters", "chars", "sha256"])

        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
            for row, name in enumerate(names):
                if name != key:
                    if key is not None:
                        yield whole()
                    key, columns, chapters, chars, digest = name, [batch.column(i).slice(row, 1) for i in range(n_keys)], 0, None, None
                some, size, d = (batch.column(n_keys + i)[row].as_py() for i in (1, 2, 3))
                chapters += some
                if size is not None:
                    chars = (chars or 0) + size
                if d is not None:
                    digest = digest or hashlib.sha256()
                    digest.update(d.encode())
        if key is not None:
            yield whole()

    return run


def manifest(editions: DataFrame, keys: Sequence[str] = ("stream",), text: str = "text", chapter: str = "chapter", made: Column | None = None, run: int | None = None) -> DataFrame:
    """Per edition: chapters, characters, and a digest of the chapters' digests in order, one after the other.

    Chapters go by whole numbers; null texts have no digest, and an edition of these alone has none.  The digests, not the texts, of an edition meet in one
    task, which hashes them as they come, DIGESTS at a time, and holds no more.  With `run` no task sees an edition's digests: up to `run` chapters in a row
    give one digest, then these, until one is left.
    """
    each = editions.select(*keys, F.col(chapter).alias("c"), F.length(text).cast("long").alias("chars"), F.sha2(F.col(text).cast("binary"), 256).alias("d"), F.lit(1).cast("long").alias("chapters"))
    level = rank_in_group(each.withColumn("__e", F.struct(*keys)), "__e", "c", "no").drop("__e").withColumn("no", F.col("no").cast("long") - 1)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("no", "d"))), lambda x: x["d"]))
    if run is None:
        parts = level.groupBy(*keys, F.floor(F.col("no") / DIGESTS).alias("no")).agg(F.sum("chapters").alias("chapters"), F.sum("chars").alias("chars"), F.when(F.count("d") > 0, joined).alias("d"))
        rows = parts.toDF(*[f"k{i}" for i in range(len(keys))], *parts.columns[len(keys) :])
        ordered = rows.repartition(*rows.columns[: len(keys)]).sortWithinPartitions(*rows.columns[: len(keys) + 1])
        kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keys)])
        out = ordered.mapInArrow(_hashed_in_order(len(keys)), kinds + "chapters long, chars long, sha256 string").toDF(*keys, "chapters", "chars", "sha256")
        return out if made is None else out.withColumn("made", made)
    done = None
    while True:
        up = level.groupBy(*keys, F.floor(F.col("no") / run).alias("no")).agg(F.sum("chapters").alias("chapters"), F.sum("chars").alias("chars"), F.sha2(joined.cast("binary"), 256).alias("d"))
        level = checkpoint(up.withColumn("__more", F.max("no").over(Window.partitionBy(*keys)) > 0))
        ready = level.filter(~F.col("__more")).select(*keys, "chapters", "chars", F.col("d").alias("sha256"))
        done = ready if done is None else done.unionByName(ready)
        level = level.filter("__more").drop("__more")
        if level.isEmpty():
            break
    out = done
    return out if made is None else out.withColumn("made", made)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], format: str = "json") -> None:
    """One folder per key value; rows of a key are brought together first, so that it gets few files."""
    df.repartition(*keys).write.partitionBy(*keys).mode("overwrite").format(format).save(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Old and new rows, the newest of each key: the highest version, and of equal versions the new table's row."""
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = ([F.desc_nulls_last(version)] if version else []) + [F.desc("__new"), F.xxhash64(*old.columns)]
    return tagged.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k", "__new")


def overwrite_partitions(df: DataFrame, path: str, by: str, format: str = "parquet") -> None:
    """Write df by the values of a column; only the folders of values that df has are replaced, the others stay as they are."""
    df.repartition(by).write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").format(format).save(path)


def carry_over(old: DataFrame, path: str) -> DataFrame:
    """Write a table that cannot be rebuilt and fail if the copy has other rows."""
    before = old.count()
    old.write.mode("errorifexists").parquet(path)
    copy = old.sparkSession.read.parquet(path)
    if (after := copy.count()) != before:
        raise ValueError(f"{before} rows before, {after} after")
    return copy


def nested_count(path: Sequence[str]) -> Column:
    """Number of the innermost elements of a column of arrays of structs with arrays in them (a field for each level); null arrays hold none."""
    def below(arrays: Column, field: str) -> Column:
        return F.flatten(F.filter(F.transform(arrays, lambda x: x[field]), lambda x: x.isNotNull()))

    inner = reduce(below, path[1:], F.col(path[0]))
    return F.greatest(F.size(inner), F.lit(0)).cast("long")


def top_values(tables: dict[str, tuple[DataFrame, str]], k: int) -> DataFrame:
    """name, value, n, rank: of each named column the k most frequent values."""
    out = None
    for name, (df, column) in tables.items():
        counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        first = counts.orderBy(F.desc("n"), "value").limit(k)
        part = first.select(F.lit(name).alias("name"), "value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("rank"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no columns")
    return out


def corpus_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of every table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_in_group(df: DataFrame, group: str, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """row_number() of each row in its group by an integer column, also for groups that hold most of the rows.

    The order column is cut into blocks of values.  Rows are ranked inside (group, block), at most `block` distinct
    values, and get the number of rows in the group's blocks before; only these counts are ordered as a whole.  A null group is a group like
    others, rows with a null order come last, and rows of equal order each get a rank.
    """
    at = F.floor(F.col(order) / block)
    cut = df.withColumn("__g", F.struct(F.col(group).alias("group"), F.when(at.isNull(), 1).otherwise(0).alias("last"), at.alias("block")))  # structs are equal where their nulls are
    before = Window.partitionBy("__g.group").orderBy("__g.last", "__g.block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("__g").agg(F.count("*").alias("__n")).select("__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = cut.withColumn("__k", F.row_number().over(Window.partitionBy("__g").orderBy(order)))
    return local.join(offsets, "__g").withColumn(name, (F.col("__k") + F.col("__before")).cast("int")).drop("__g", "__k", "__before")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, chapter, doc_id, text: documents of a source in order of id; every row is a chapter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("stream"), "doc_id", "text")
    return rank_in_group(docs, "stream", "doc_id", "chapter").select("stream", "chapter", "doc_id", "text")


def concat_chapter(blocks: DataFrame, keys: Sequence[str], order: str, text: str = "text", sep: str = "\n", kinds: Sequence[str] | None = None, kind: str = "kind", exclude: DataFrame | None = None) -> DataFrame:
    """keys, text: the blocks of each chapter joined in order; only blocks of `kinds`, if given, and not those whose keys are in `exclude`.

    Null texts are left out; a chapter without any text has an empty one.  A chapter, not a stream, is brought together.
    """
    used = blocks if kinds is None else blocks.filter(F.col(kind).isin(list(kinds)))
    if exclude is not None:
        used = used.join(exclude.select(*keys).distinct(), list(keys), "left_anti")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda x: x[text])
    return used.groupBy(*keys).agg(F.concat_ws(sep, gathered).alias(text))


def book_union(books: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The chapters of several books with their book in `src`; of chapters with equal keys those of the last book named stay."""
    out = None
    for src, df in books.items():
        tagged = df.withColumn("src", F.lit(src))
        out = tagged if out is None else out.join(tagged.select(*keys).distinct(), list(keys), "left_anti").unionByName(tagged)
    if out is None:
        raise ValueError("no books")
    return out


def blocks(chapter_table: DataFrame) -> DataFrame:
    """stream, chapter, doc_id, seq, text: the lines of the chapters."""
    return chapter_table.select("stream", "chapter", "doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


# The same tables in SQL.
CHAPTERS_SQL = "chapters AS (SELECT source AS stream, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS chapter, doc_id, text FROM documents)"
BLOCKS_SQL = "blocks AS (SELECT stream, chapter, doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq, unnest(string_split(text, chr(10))) AS text FROM chapters)"
