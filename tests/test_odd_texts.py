"""Queries over odd texts (long streams, nulls, empty texts) compared with DuckDB."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from codexweave.sources import corpus


def same_as_sql(spark, at, name, documents):
    path = f"{at}/documents.parquet"
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    df = entry_module.queries()[name](spark, str(at))
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry_module.oracle_sql()[name]})").fetchall()
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_manifest_of_long_streams(spark, tmp_path):
    documents = [(i, f"text {i}", "en", "long") for i in range(5000)] + [(9000 + i, t, "en", s) for i, (t, s) in enumerate([("a", "b"), (None, "b"), ("", "b"), (None, "none"), (None, "none"), ("", "empty"), ("x", None), ("y", None), ("z", "")])]
    same_as_sql(spark, tmp_path, "edition_manifest", documents + [(None, "no id", "en", "long")])


def test_manifest_hashes_all_digests_in_order(spark, monkeypatch):
    monkeypatch.setattr(corpus, "DIGESTS", 3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "2")
    rows = [(s, v, c, f"{s}{v}{c}") for s, v, n in (("a", 1, 1), ("a", 2, 3), ("b", 1, 20)) for c in range(n)]
    df = spark.createDataFrame(rows, "stream string, k0 int, chapter int, text string").repartition(4)
    got = {(r["stream"], r["k0"]): (r["chapters"], r["chars"], r["sha256"], r["made"]) for r in corpus.manifest(df, ["stream", "k0"], made=F.lit("now")).collect()}
    spark.conf.set(batch, before)
    for s, v, n in (("a", 1, 1), ("a", 2, 3), ("b", 1, 20)):
        texts = [t for x, y, _, t in rows if (x, y) == (s, v)]
        digests = "".join(hashlib.sha256(t.encode()).hexdigest() for t in texts)
        assert got.pop((s, v)) == (n, sum(map(len, texts)), hashlib.sha256(digests.encode()).hexdigest(), "now")
    assert not got


@pytest.mark.parametrize("name", ["cross_entropy", "cross_halves", "ngram_coverage", "ngrams", "perplexity", "spectrum"])
def test_empty_texts_count_as_in_sql(spark, tmp_path, name):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh .", range(10, 0, -1), k=rng.choice((7, 40, 400)))) for _ in range(90)]
    texts[3::4] = [rng.choice(("", "", None, "12, 3", "x\0ab\0\0cdef", "a")) for _ in texts[3::4]]
    same_as_sql(spark, tmp_path, name, [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)])
