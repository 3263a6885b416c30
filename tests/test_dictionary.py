import random

import pytest
from pyspark.sql import functions as F

from codexweave.operators import dictionary, facts, ledgers


def plain(text, term):
    """Offsets of non-overlapping occurrences."""
    out, at = [], text.find(term)
    while at >= 0:
        out.append(at)
        at = text.find(term, at + len(term))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_offsets_of_all_terms_match_the_plain_search(spark, block_rows):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("aab漢😀 ") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (5, "aaaa")]
    terms = ["a", "aa", "aab", "b漢", "😀", "漢😀", "zz", "", None, "aa", " "]
    d = spark.createDataFrame(texts, "id int, text string").withColumn("hits", F.lit("clash")).repartition(3)
    t = spark.createDataFrame([(x, i) for i, x in enumerate(terms)], "term string, no int")
    got = dictionary.find_terms(d, t, keep=["id", "hits"], pad=2, block_rows=block_rows).collect()
    assert len(got) == len(texts)
    by_id = sorted((r[0], sorted((h["term"], tuple(h["at"])) for h in r[2])) for r in got)
    want = sorted((i, sorted((x, tuple(plain(t or "", x))) for x in {y for y in terms if y} if plain(t or "", x))) for i, t in texts)
    assert by_id == want
    context = {(r[0], h["term"], a): c for r in got for h in r[2] for a, c in zip(h["at"], h["context"])}
    for (i, term, a), c in context.items():
        assert any(x == i and c == f"{(t or '')[max(0, a - 2):a]}〔{term}〕{(t or '')[a + len(term):a + len(term) + 2]}" for x, t in texts)


def test_terms_with_several_rows_and_texts_without_terms(spark):
    texts = spark.createDataFrame([(1, "moon sun moon"), (2, "none"), (3, None), (3, None)], "id int, text string")
    terms = spark.createDataFrame([("moon", "M"), ("moon", "N"), ("sun", "S"), ("", "E"), (None, "0")], "term string, name string")
    for options in ({}, {"block_rows": 1}):
        hits = facts.term_hits(texts, terms, keep=["id"], **options)
        assert sorted((r["id"], r["term"], r["name"], r["n"], tuple(r["at"])) for r in hits.collect()) == [(1, "moon", "M", 2, (0, 9)), (1, "moon", "N", 2, (0, 9)), (1, "sun", "S", 1, (5,))]
        every = facts.holding_or_none(texts, terms, "text", "term", **options)
        assert sorted(map(repr, ((r["id"], r["name"]) for r in every.collect()))) == sorted(map(repr, [(1, "M"), (1, "N"), (1, "S"), (2, None), (3, None), (3, None)]))
        longest = dictionary.with_longest(texts, terms, "text", "term", "best", **options)
        assert sorted(map(repr, map(tuple, longest.select("id", "best").collect()))) == sorted(map(repr, [(1, "moon"), (2, None), (3, None), (3, None)]))
        none = facts.holding(texts, terms.filter("false"), **options)
        assert none.count() == 0 and none.columns == ["id", "text", "term", "name"]


@pytest.mark.parametrize("limit", [0, 100])
def test_positions_between_whole_numbers_are_in_range(spark, limit):
    events = spark.createDataFrame([(1, 1.5), (2, 3.0), (3, 3.01), (4, None), (5, -0.5), (6, 900.25)], "id int, at double")
    ranges = spark.createDataFrame([("x", 1, 3), ("y", -1, 0), ("z", 2, 2000), ("w", 5, 4)], "name string, lo int, hi int")
    got = sorted((r["id"], r["name"]) for r in facts.range_join(events, ranges, "at", "lo", "hi", broadcast_rows=limit).collect())
    assert got == [(1, "x"), (2, "x"), (2, "z"), (3, "z"), (5, "y"), (6, "z")]


def test_concordance_carries_no_text(spark):
    t = spark.createDataFrame([(1, "ab" * 50)], "ch int, text string")
    hits = ledgers.kwic(t, spark.createDataFrame([("a",), ("b",)], "term string"), ["ch"], 3)
    assert hits.count() == 100 and "text" not in hits.columns


@pytest.mark.parametrize("chain, written", [(4, 0), (0, 5)])
def test_small_blocks_share_a_pass(spark, monkeypatch, chain, written):
    """Texts are only written where more blocks follow than a pass may hold; hits of earlier passes keep their places."""
    tables, plain_checkpoint = [], dictionary.checkpoint
    monkeypatch.setattr(dictionary, "checkpoint", lambda df: tables.append("hits" in df.columns) or plain_checkpoint(df))
    monkeypatch.setattr(dictionary, "CHAIN", chain)
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 5, 30])))) for i in range(50)]
    terms = [x + y for x in "abc" for y in "def"] + ["a", "b", "c"]
    d, t = spark.createDataFrame(texts, "id int, text string").repartition(2), spark.createDataFrame([(x,) for x in terms], "term string")
    monkeypatch.setattr(dictionary, "blocks", lambda *_: iter([terms[i : i + 2] for i in range(0, 12, 2)]))
    got = {r["id"]: {h["term"]: h["at"] for h in r["hits"]} for r in dictionary.find_terms(d, t, keep=["id"], block_rows=2).collect()}
    assert got == {i: {x: plain(s, x) for x in terms if x in s} for i, s in texts}
    assert sum(tables) == written
