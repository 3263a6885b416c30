"""A cleaning pipeline over documents: language ID, near-dedup, decontamination, secret redaction, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.  Decisions:

1.  language_id: documents without a clear language go.
2.  near_dedup: of each class of near duplicates the document with the least id stays (of rows that are equal in id
    and text, one).
3.  decontamination: documents that hold a window of a benchmark item go.
4.  secret_scan: live-looking secrets are masked in the text; n_chars follows the text.
5.  bpe: token ids of the texts and SHA-256 of what the ids decode to, with id, language and source.

Rows with null text have no language and go in stage 1; rows with null id stay unless their text is dropped.  Of rows equal in id and text one
stays in stage 2.  An empty table gives an empty result.  Other columns, whatever their names, are carried along: stages see
columns by place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexweave.llm import bpe, decontamination, language_id, near_dedup, secrets
from codexweave.llm.common import bound_batches, checkpoint, numbered, place, table, without
from codexweave.llm.queries import tokenizer_path


def _keyed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """doc_id, text and a hash of both of every document; the hash as a column over numbered(docs)."""
    key = F.xxhash64(place(docs, "doc_id"), place(docs, "text"))
    return numbered(docs).select(place(docs, "doc_id").alias("doc_id"), place(docs, "text").alias("text"), key.alias("key")), key


def keep_clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is clear.  Learns from a bounded sample of the labelled rows."""
    bound_batches(spark)
    rows, key = _keyed(docs)
    found = language_id.identify(rows, language_id.train(docs), keep=("key",))
    return without(docs, key, found.filter("rejected").select("key"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near copies of a document with a smaller id."""
    bound_batches(spark)
    return near_dedup.keep_one(docs, near_dedup.classes(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    rows, key = _keyed(docs)
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=("key",))
    return without(docs, key, found.filter(F.size("hit_spans") > 0).select("key"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with live-looking secrets masked; n_chars, where there is one, counts the new text."""
    out = secrets.redact(docs, secrets.scan(docs, owner="source", repository=("source", "lang")))
    if "n_chars" not in docs.columns:
        return out
    at, rows = docs.columns.index("n_chars"), numbered(out)
    return rows.withColumn(f"c{at}", F.length(place(docs, "text")).cast(docs.schema.fields[at].dataType)).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decoded_sha256 of every document."""
    bound_batches(spark)
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("lang", "source"), decoded="digest")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_clear_language),
    ("near_dedup", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: Compression, sampling and token merging have no SQL form; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
