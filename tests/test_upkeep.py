"""What is brought up to date by parts, and tables that no SQL is held against."""

import hashlib

from pyspark.sql import functions as F

from codexweave.operators import collate, events, gates, ledgers
from codexweave.sources import corpus


def test_partitions_of_other_sources_stay(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, what string, src string")
    corpus.overwrite_partitions(rows((1, "a", "main"), (2, "b", "main"), (3, "c", "later")), path, "src")
    corpus.overwrite_partitions(rows((4, "d", "later"), (5, "e", "new")), path, "src")
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "src").collect())) == [(1, "main"), (2, "main"), (4, "later"), (5, "new")]


def test_only_changed_documents_are_checked_again(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "good too"), (4, None)], "chapter int, text string")
    seen = []

    def run(d):
        seen.append(sorted(r["chapter"] for r in d.collect()))
        return d.select("chapter", F.coalesce(F.col("text").contains("bad"), F.lit(False)).alias("failed"), F.lit("").alias("issues"))

    none = spark.createDataFrame([], "chapter int, failed boolean, issues string, digest string")
    first = gates.recheck_changed(docs, none, run)
    stored = spark.createDataFrame([tuple(r) for r in first.collect()], first.schema)
    assert gates.recheck_changed(docs, stored, run).count() == 4
    later = spark.createDataFrame([(1, "bad now"), (2, "bad one"), (4, ""), (5, "new")], "chapter int, text string")
    got = {r["chapter"]: r["failed"] for r in gates.recheck_changed(later, stored, run).collect()}
    assert got == {1: True, 2: True, 4: False, 5: False}
    assert seen == [[1, 2, 3, 4], [], [1, 5]]


def test_manifest_in_runs(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(s, c, f"{s}{c}") for s, n in (("a", 1), ("b", 3), ("c", 20)) for c in range(1, n + 1)]
    df = spark.createDataFrame(rows, "stream string, chapter int, text string").repartition(3)

    def tree(texts):
        level = [sha(t) for t in texts]
        while True:
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
            if len(level) == 1:
                return level[0]

    got = {r["stream"]: (r["chapters"], r["chars"], r["sha256"]) for r in corpus.manifest(df, run=3).collect()}
    assert got == {s: (n, sum(len(t) for x, _, t in rows if x == s), tree([t for x, _, t in rows if x == s])) for s, n in (("a", 1), ("b", 3), ("c", 20))}
    assert corpus.manifest(df.filter("false")).count() == 0


def test_stray_colours_and_scenes(spark):
    b = spark.createDataFrame([(1, "她穿着大红袄，手里是绿扇。桌上一件青衫，远处是红日当空照着大地"), (2, "穿红"), (3, None), (4, "")], "id int, text string")
    got = ledgers.colour_facts(b, ["id"], ["穿", "戴"], ["袄", "衫"], {"red": ["红", "大红"], "green": ["绿", "青"]}, "，。", 3)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(1, 3, "大红", "red", "scene"), (1, 17, "青", "green", "stray")]
    assert {r["context"] for r in got.collect()} == {"她穿着大红袄", "上一件青衫，远"}
    scenes = spark.createDataFrame([(1, "袄", "P"), (1, "袄", "P"), (9, "衫", "Q"), (2, "x", None)], "id int, garment string, person string")
    cast = ledgers.garment_cast(scenes, got, ["id"])
    assert sorted(map(repr, map(tuple, cast.collect()))) == sorted(map(repr, [("P", 2, "red", 1, 1), ("Q", 1, None, None, None)]))
    series = ledgers.garment_series(scenes, got, b, ["id"])
    assert {r["id"]: (r["scenes"], r["colours"]) for r in series.collect()} == {1: (2, 2), 2: (1, 0)}


def test_amount_series(spark):
    found = spark.createDataFrame([(1, 5.0), (1, 7.0), (3, 10.0), (9, 1.0)], "ch int, amount double")
    series, anchors = ledgers.amount_series(found, "ch", {"early": (1, 3), "late": (8, 10), "none": (4, 5)})
    assert sorted(map(tuple, series.collect())) == [(1, 2, 12.0), (3, 1, 10.0), (9, 1, 1.0)]
    assert sorted(map(tuple, anchors.collect())) == [("early", 3, 22.0, 7.0), ("late", 1, 1.0, 1.0)]


def test_event_places(spark):
    scenes = spark.createDataFrame([(3, 0, 2, "起初宝玉笑道：来。"), (3, 1, 2, "后来黛玉与宝玉同行")], "ch int, scene int, n int, text string")
    people = spark.createDataFrame([("宝玉", "宝玉"), ("黛玉", "黛玉")], "name string, term string")
    found = spark.createDataFrame([(3, 0, "宝玉"), (3, 1, "黛玉")], "ch int, scene int, person string")
    got = {r["scene"]: (r["t"], r["quote"], r["src"]) for r in events.event_facts(found, scenes, ["ch", "scene"], people, "ch", "scene", "n", F.lit("main"), 40).collect()}
    assert got == {0: (3.25, "起初宝玉笑道：来。", "main"), 1: (3.75, "后来黛玉与宝玉同行", "main")}


def test_nested_counts(spark):
    df = spark.createDataFrame([(1, [([("a",), ("b",)],), (None,), ([],)]), (2, []), (3, None)], "id int, chapters array<struct<speeches: array<struct<t: string>>>>")
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", corpus.nested_count(["chapters"]).alias("a"), corpus.nested_count(["chapters", "speeches"]).alias("b")).collect()}
    assert got == {1: (3, 2), 2: (0, 0), 3: (0, 0)}


def test_coverage_of_a_variant_map(spark):
    texts = spark.createDataFrame([("abä",), ("äöxxxxx",), (None,)], "text string")
    common, variants = spark.createDataFrame([("a",), ("b",)], "char string"), spark.createDataFrame([("ä", "a"), ("a", "b")], "source string, target string")
    share, residue = collate.variant_coverage(texts, variants, "a-zäö", common)
    assert tuple(share.first()) == (10, 2, 2, 0.4) and [tuple(r) for r in residue.collect()] == [("x", 5)]
