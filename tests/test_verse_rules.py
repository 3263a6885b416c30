import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codexweave.operators import verse

RHYMES = {"山": "an", "间": "an", "关": "an", "天": "an", "人": "en", "门": "en", "水": "ui", "风": "eng", "月": "ue", "雪": "ue"}
R = verse.Rules(function_chars="了的之", imagery="花月风雪山水", rhymes=RHYMES, anchor="诗曰|题诗", edge="笑道|看了", said=r"^.{1,3}道[：:]")


def found(text, **more):
    r = verse.Rules(**({f: getattr(R, f) for f in ("function_chars", "imagery", "rhymes", "anchor", "edge", "said")} | more))
    return [(text[a:b], m["n"], m["main_len"]) for a, b, _, m in verse.poems_of(text, r)]


FIVE = "甲乙丙丁山，戊己庚辛间。子丑寅卯水，辰巳午未关。"
FOUR = "花甲乙山，月丙丁间。风子丑水，雪辰巳关。"
PROSE = "这是一段很长很长的普通叙事文字没有停顿，"


def test_four_lines_of_five_need_rhyme_or_an_anchor():
    assert found(PROSE + FIVE) == [(FIVE[:-1], 4, 5)]
    no_rhyme = "甲乙丙丁戊，戊己庚辛壬。子丑寅卯辰，辰巳午未申。"  # none of these is in the table
    assert found(PROSE + no_rhyme) == []
    assert found(PROSE + "诗曰：" + "\n" + no_rhyme) == [(no_rhyme[:-1], 4, 5)]
    wordy = no_rhyme.replace("甲乙", "了的")  # a share of function characters of 0.1 is too much without rhyme, and just enough with it
    assert found("诗曰：\n" + wordy, edge_xu=1.0) == [] and found(FIVE.replace("甲乙", "了的"), edge_xu=1.0) == [(FIVE[:-1].replace("甲乙", "了的"), 4, 5)]


def test_long_verse_needs_more_rhyme():
    eight = FIVE + "甲乙丙丁月，戊己庚辛人。子丑寅卯风，辰巳午未门。"  # two of four in either class: 0.5
    assert [n for _, n, _ in found(eight)] == [7]  # seven clauses still are a short poem
    good = FIVE + "甲乙丙丁月，戊己庚辛天。子丑寅卯风，辰巳午未门。"  # three of four
    assert [n for _, n, _ in found(good)] == [8]
    some = good.replace("甲乙丙丁山", "了的之了山")  # 4 of 40: below 0.11
    more = some.replace("戊己庚辛间", "的己庚辛间")  # 5 of 40: over it, and over 0.10 in any part but the whole
    assert [n for _, n, _ in found(some, edge_xu=1.0)] == [8]
    assert found("诗曰：\n" + more, edge_xu=1.0)[0][1] == 8


def test_lines_of_four_need_anchor_rhyme_and_imagery():
    assert found(FOUR) == [] and found("题诗：\n" + FOUR) == [(FOUR[:-1], 4, 4)]
    plain = FOUR.translate(str.maketrans("花月风雪山水", "庚庚庚庚天天"))
    assert found("题诗：\n" + plain) == []


def test_couplets_need_an_anchor():
    two = "甲乙丙丁戊，己庚辛壬癸。"
    assert found(two, least_lines=2) == [] and found("诗曰：\n" + two, least_lines=2) == [(two[:-1], 2, 5)]
    assert found("诗曰：\n" + two) == []  # shorter than least_lines


def test_edges_are_cut_by_word_length_and_density():
    assert found(FIVE + "众人看了都。") == [(FIVE[:-1], 4, 5)]
    assert found("了的之了的。" + FIVE, rules=(verse.Rule((5,), (4, 9), 0.5, 0.3),)) == [(FIVE[:-1], 4, 5)]


def test_speakers_are_taken_off():
    r = verse.Rules(function_chars="了", rhymes=RHYMES, said=R.said)
    [(a, b, kept, _)] = verse.poems_of("黛玉道：" + FIVE, r)
    assert kept[0].speaker == "黛玉道" and kept[0].body == "甲乙丙丁山" and a == 4


def slow(text, r):
    clauses, out, i = verse.clauses_of(text, r), [], 0

    def measure(some):
        sizes = Counter(c.size for c in some)
        main, hit = sizes.most_common(1)[0]
        chars = max(1, sum(c.size for c in some))
        even = [c.rhyme for c in some[1::2] if c.rhyme]
        return {"n": len(some), "main_len": main, "uniform": hit / len(some), "xu": sum(c.xu * c.size for c in some) / chars, "imagery": sum(c.images for c in some) / chars, "rhyme": Counter(even).most_common(1)[0][1] / len(even) if len(even) > 1 else 0.0}

    while i < len(clauses):
        best, run = None, 0
        ahead = any(w in text[max(0, clauses[i].start - r.anchor_back) : clauses[i].start] for w in r.anchor.split("|"))
        for j in range(i, min(len(clauses), i + r.window)):
            m = measure(clauses[i : j + 1])
            if any(m["main_len"] in x.lengths and x.clauses[0] <= m["n"] <= x.clauses[1] and m["uniform"] >= x.uniform and round(m["xu"], 9) <= x.most_xu and m["rhyme"] >= x.least_rhyme and m["imagery"] >= x.least_imagery and (ahead or not x.anchored) for x in r.rules):
                best = j
            run = run + 1 if not r.usual[0] <= clauses[j].size <= r.usual[1] or clauses[j].xu > r.prose_xu else 0
            if run > r.prose_run:
                break
        if best is None:
            i += 1
            continue
        kept = clauses[i : best + 1]
        bad = lambda c: c.xu > r.edge_xu or not r.edge_lengths[0] <= c.size <= r.edge_lengths[1] or any(w in c.body for w in r.edge.split("|"))
        while kept and bad(kept[0]):
            kept = kept[1:]
        while kept and bad(kept[-1]):
            kept = kept[:-1]
        if len(kept) >= r.least_lines:
            out.append((kept[0].start, kept[-1].end, kept, measure(kept)))
        i = best + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_windows_match_those_counted_anew(spark, seed):
    rng = random.Random(seed)
    chars = "甲乙丙丁戊己" * 3 + "了的之花月风雪山水间关人门"
    r = verse.Rules(function_chars="了的之", imagery="花月风雪山水", rhymes=RHYMES, anchor="诗曰|题诗", edge="笑道|看了", window=20, prose_run=2, least_lines=2)
    texts = ["".join("".join(rng.choice(chars) for _ in range(rng.choice([4, 5, 5, 5, 5, 7, 7, 12]))) + rng.choice("，。！\n") + rng.choice(["", "", "", "诗曰：\n"]) for _ in range(40)) for _ in range(12)]
    near = lambda m: {k: round(v, 9) for k, v in m.items()}
    for t in texts:
        assert [(a, b, near(m)) for a, b, _, m in verse.poems_of(t, r)] == [(a, b, near(m)) for a, b, _, m in slow(t, r)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "ch int, text string")
    got = sorted((x["ch"], x["start"], x["n"]) for x in verse.verse_by_rules(d, ["ch"], r).collect())
    assert got == sorted((i, a, m["n"]) for i, t in enumerate(texts) for a, _, _, m in slow(t, r)) and got


def test_fixed_poems_have_the_facts_of_a_rebuild(spark):
    poems = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate([FIVE, FOUR, "同前" + FIVE, "", None, "雪雪雪，月。"])], "id int, title string, text string")
    images = spark.createDataFrame([("月", "sky"), ("雪", "sky"), ("花", "plant")], "term string, category string")
    facts = [f.checkpoint() if spark.sparkContext.getCheckpointDir() else f for f in verse.poem_facts(poems, R, images)]
    overrides = spark.createDataFrame([(1, "花月一句，雪山二句。"), (4, "月月，月。"), (0, FIVE)], "id int, text string")
    after = verse.poem_fixes(poems.filter("id <> 3").unionByName(poems.filter("id = 5").withColumn("id", F.lit(9))), overrides, ["同前"], {"雪雪": "Snow"})
    got = verse.fixed_poem_facts(poems, after, facts, R, images)
    want = verse.poem_facts(after, R, images)
    for g, w in zip(got, want):
        assert sorted(map(repr, g.collect())) == sorted(map(repr, w.collect())) and w.count() > 0
    # only changed poems are measured: of the old metrics those of the same texts are kept as they were
    marked = [facts[0].withColumn("xu", F.lit(-1.0)), *facts[1:]]
    kept = {r["id"]: r["xu"] for r in verse.fixed_poem_facts(poems, after, marked, R, images)[0].collect()}
    assert {i for i, x in kept.items() if x == -1.0} == {0, 5} and set(kept) == {0, 1, 4, 5, 9}


def test_spans_of_routes_are_found_once(spark):
    """Overlaps compare spans with spans; what finds them, such as verse_by_form, runs over the texts once."""
    found = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            found.add(len(batch))
            yield batch

    spans = spark.createDataFrame([(1, 0, 9, "form"), (1, 5, 12, "seed"), (1, 12, 20, "form"), (2, 0, 4, "title")], "ch int, start long, end long, route string")
    got = verse.drop_overlaps(spans.mapInPandas(count, spans.schema), ["ch"], ["seed", "form", "title"]).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 12, "seed"), (1, 12, 20, "form"), (2, 0, 4, "title")]
    assert found.value == 4
