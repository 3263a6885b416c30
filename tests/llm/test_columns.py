"""Extra columns of documents, whatever they are called, neither change results nor get lost."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codexweave.llm import bpe, decontamination, language_id, lexical_search, line_dedup, merkle, near_dedup, pii, quality_rules, secrets, substring_dedup, token_counts, warc
from codexweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["__key", "__among", "__no", "__map", "__gone", "__fate", "__hot0", "__parts", "__salt", "__live", "__mark", "__id", "__text", "c0", "c1", "key", "a.b", "TEXT", "Doc_Id", "LANG", "SOURCE", "N_chars", "bands", "label", "id", "`", " "]


def odd(docs):
    """docs between odd columns, each with its own name as its value."""
    out = docs.select(*[F.lit(c).alias(f"x{i}") for i, c in enumerate(ODD)], "*", F.lit(True).alias("last"))
    return out.toDF(*ODD, *docs.columns, "__Key")


@pytest.mark.parametrize("stage", range(4))
def test_stages_carry_odd_columns(spark, docs, empty, stage):
    plain = docs.drop("n_words")
    frame = odd(plain)
    name, f = corpus_pipeline.STAGES[stage]
    got, want = f(spark, frame, SF), f(spark, plain, SF)
    assert got.columns == frame.columns
    n = len(ODD)
    rows = got.collect()
    assert sorted(map(repr, (tuple(r)[n:-1] for r in rows))) == sorted(map(repr, map(tuple, want.collect())))
    assert all(tuple(r)[:n] == tuple(ODD) and r[-1] is True for r in rows)
    assert f(spark, odd(empty.drop("n_words")), SF).count() == 0


def test_last_stage_reads_odd_columns(spark, docs):
    plain = docs.drop("n_words")
    f = corpus_pipeline.STAGES[-1][1]
    got, want = f(spark, odd(plain), SF), f(spark, plain, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


OPERATORS = {
    "secrets": lambda d: secrets.digests(secrets.scan(d)),
    "substring": substring_dedup.remove_repeats,
    "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path("piece_bpe_32k.model")),
    "near": near_dedup.classes,
    "quality": lambda d: quality_rules.assess(d).drop("failed_rule"),
    "pii": lambda d: pii.digests(pii.scan(d)),
    "bpe": lambda d: bpe.encode_digests(d, tokenizer_path("word_bpe_49k.json")),
    "language": lambda d: language_id.identify(d, language_id.train(d)),
    "decontamination": lambda d: decontamination.decontaminate(d, odd(d.sparkSession.createDataFrame([("i", "one x x")], "item_id string, text string"))),
    "search": lambda d: lexical_search.search(d, odd(d.sparkSession.createDataFrame([("i", "one x x")], "item_id string, text string"))),
    "lines": lambda d: line_dedup.remove_lines(d, min_docs=2),
    "merkle": lambda d: merkle.check(merkle.manifest(d).proofs),
    "warc": lambda d: warc.capture_index(d, id_col="doc_id", url_col="source", html_col="text").select("page_id", "payload_digest", "record_type", "refers_to"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_read_odd_columns(docs, name):
    plain = docs.drop("n_words").filter("doc_id % 3 <> 1")
    f = OPERATORS[name]
    assert sorted(map(repr, f(odd(plain)).collect())) == sorted(map(repr, f(plain).collect()))
