import json

import pytest
from pyspark.sql import functions as F

from codexweave.sources import corpus as src


def test_corpus_file(spark, tmp_path):
    block = lambda i, kind, text: {"id": i, "kind": kind, "text": text, "page": i, "editions": ["甲戌"], "atype": "侧批", "ink": "朱"}
    doc = {"meta": {"x": 1}, "chapters": [{"no": 1, "title": "甲", "blocks": [block(1, "正文", "a"), block(2, "批语", "b")]}, {"no": 2, "title": "乙", "blocks": [block(3, "校记", "c")]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, ensure_ascii=False))
    blocks, chapters = src.read_corpus(spark, str(tmp_path / "c.json"))
    assert blocks.count() == 3 and blocks.first()["editions"] == ["甲戌"]
    got = {r["chapter"]: (r["title"], r["page_start"], r["page_end"], r["n_main"], r["n_anno"], r["n_note"]) for r in chapters.collect()}
    assert got == {1: ("甲", 1, 2, 1, 1, 0), 2: ("乙", 3, 3, 0, 0, 1)}


def test_dictionary_and_values(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# names\n宝玉|怡红公子,宝二爷|男\n\n黛玉|—\n")
    d = src.read_dictionary(spark, str(tmp_path / "d.txt"), ["name", "aliases", "gender"])
    assert sorted(map(tuple, d.collect())) == [("宝玉", "怡红公子,宝二爷", "男"), ("黛玉", "—", "")]
    extra = spark.createDataFrame([("宝玉", "宝二爷", "男")], d.schema)
    assert src.explode_multivalue(d, "aliases", extra=extra).count() == 2


def test_edition_file(spark, tmp_path):
    doc = {"chapters": {"1": {"title": "t", "text": "x", "annos": [{"editions": ["庚"], "atype": "a", "text": "n"}]}, "12": {"title": "u", "text": "y", "annos": []}}}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    got = src.read_edition(spark, str(tmp_path / "w.json"), "w").orderBy("chapter").collect()
    assert [(r["stream"], r["chapter"], r["title"], len(r["annos"])) for r in got] == [("w", 1, "t", 1), ("w", 12, "u", 0)]


def test_keyed_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "2024"), (2, "b", "2025")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "stale", "2023"), (1, "c", "2024"), (3, "d", "2024")], old.schema)
    assert sorted((r["k"], r["v"]) for r in src.upsert(old, new, ["k"], "made").collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert [r["k"] for r in src.pending(new, old, ["k"]).collect()] == [3]
    assert src.carry_over(old, str(tmp_path / "carried")).count() == 2
    with pytest.raises(Exception):
        src.carry_over(old, str(tmp_path / "carried"))
    src.write_partitioned(old.withColumn("chapter", F.col("k")), str(tmp_path / "parts"), ["chapter"])
    assert sorted(p.name for p in (tmp_path / "parts").glob("chapter=*")) == ["chapter=1", "chapter=2"]


def test_rank_crosses_blocks(spark):
    rows = [(s, i) for s in "ab" for i in range(0, 300, 1 + (s == "b") * 2)]
    got = src.rank_in_group(spark.createDataFrame(rows, "s string, i long"), "s", "i", "r", block=7).collect()
    want = {(s, i): k + 1 for s in "ab" for k, (_, i) in enumerate(r for r in rows if r[0] == s)}
    assert {(r["s"], r["i"]): r["r"] for r in got} == want


def test_no_row_is_lost_in_order(spark):
    from codexweave.operators import ordered
    from codexweave.sources import corpus
    from pyspark.sql import functions as F

    rows = [(None, 1, 5), ("a", None, 7), ("a", 2, 1), ("a", 2, 1), ("a", 200_000, 3), (None, None, 2)]
    d = spark.createDataFrame(rows, "g string, o long, v long")
    assert ordered.running_sum(d, ["g"], "o", F.col("v"), "s").count() == len(rows)
    assert {r["s"] for r in ordered.running_sum(d, ["g"], "o", F.col("v"), "s").filter("o = 200000").collect()} == {12}
    assert ordered.fill_forward(d, ["g"], "o", "v", "f").count() == len(rows)
    assert ordered._running_max(d, ["g"], "o", F.col("v"), "m").count() == len(rows)
    assert ordered.islands(d.filter("o is not null"), ["g"], "o", 3).count() == 4
    got = sorted((r["g"] or "", r["k"]) for r in corpus.rank_in_group(d, "g", "o", "k").collect())
    assert got == [("", 1), ("", 2), ("a", 1), ("a", 2), ("a", 3), ("a", 4)]


def test_chapters_keep_every_document(spark, tmp_path):
    from codexweave.sources import corpus

    rows = [(1, "x", "s"), (1, "y", "s"), (None, "z", "s"), (2, None, None), (3, "w", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["stream"] or "", r["chapter"], r["doc_id"] or 0) for r in corpus.chapters(spark, str(tmp_path)).collect())
    assert got == [("", 1, 2), ("s", 1, 1), ("s", 2, 1), ("s", 3, 3), ("s", 4, 0)]


def test_concat_chapter_and_book_union(spark):
    from codexweave.sources import corpus

    b = spark.createDataFrame([(1, 2, "b", "m"), (1, 1, "a", "m"), (1, 3, None, "m"), (2, 1, "n", "note"), (3, 1, "x", "m")], "chapter int, id int, text string, kind string")
    out = corpus.concat_chapter(b, ["chapter"], "id", sep="", kinds=["m"], exclude=spark.createDataFrame([(3,)], "chapter int"))
    assert [tuple(r) for r in out.collect()] == [(1, "ab")]
    main, later = spark.createDataFrame([(1, "old"), (2, "old")], "chapter int, text string"), spark.createDataFrame([(2, "new"), (3, "new")], "chapter int, text string")
    got = sorted(tuple(r) for r in corpus.book_union({"main": main, "later": later}, ["chapter"]).collect())
    assert got == [(1, "old", "main"), (2, "new", "later"), (3, "new", "later")]


def test_template_arguments_with_links():
    from codexweave.functions.helpers import expand_templates

    assert expand_templates("{{center|[[A|long label]]}} {{x|a|bcd|k=vvvvv}}") == "[[A|long label]] bcd"
