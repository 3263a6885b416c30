import gc
import weakref

import brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codexweave.llm import bpe, common, language_id, near_dedup
from codexweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_in_order_with_the_columns_of_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        assert out.columns == columns
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "decontamination":
            hit = {x[0] for x in brute.contamination([(i, r["text"]) for i, r in before.items()], items) if x[5]}
            assert set(after) == set(before) - hit
        if name == "secret_scan":
            assert set(after) == set(before)
            changed = {i for i in after if after[i]["text"] != before[i]["text"]}
            assert all("[SECRET]" in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"]) for i in changed)
            assert all(sum(brute.secrets(before[i]["text"])[:3]) for i in changed)
        docs = out
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: library.encode(r["text"], add_special_tokens=False).ids for i, r in after.items()}
    assert {r["doc_id"]: r["ids"] for r in final} == ids
    assert {r["doc_id"]: r["decoded_sha256"] for r in final} == {i: brute.HEX(library.decode(x, skip_special_tokens=False)) for i, x in ids.items()}


def test_stages_take_odd_rows(spark, docs, empty):
    for frame in (docs.withColumn("row", F.lit("clash")).withColumn("rejected", F.lit(1)).withColumns({c: F.lit(c) for c in ("among", "key", "gone", "live", "spans", "id", "among_", "bands")}), empty):
        columns = frame.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).count()


def test_run_gives_the_kept_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 100 < out.count() <= 200 and out.filter("size(ids) <> n_tokens").count() == 0


def test_workers_let_go_of_tables_that_refer_to_themselves():
    """A worker serves one stage after another: the tokenizer's tables must be gone when the next operator begins, without waiting for Python's own collections."""
    gc.disable()
    try:
        bpe.encoder.cache_clear()
        common.hold("bpe", bpe.encoder.cache_clear)
        kept = weakref.ref(bpe.encoder(tokenizer_path("word_bpe_49k.json")))
        common.hold("bpe", bpe.encoder.cache_clear)
        assert kept() is not None
        common.hold("near_dedup", near_dedup._donors.cache_clear)
        assert kept() is None
    finally:
        gc.enable()


def test_pipeline_starts_no_second_kind_of_python_workers(spark, docs, monkeypatch):
    """A frame made of a list of rows is a Python job with a daemon and workers of its own; ids and texts here have links and then none."""
    made = []
    frame = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (made.append(type(data)), frame(self, data, *a, **b))[1])
    plain = docs.drop("n_words")
    language_id.train(plain)
    near_dedup.classes(plain).count()
    near_dedup.classes(plain.filter("doc_id < 0")).count()
    assert list not in made
