"""poet_stats leaves out no poet and no image."""

from collections import Counter, defaultdict

import pytest

from codexweave import registry
from codexweave.operators import verse
from codexweave.plans import collation_queries

SF = "/root/testdata/sf0.001"


def test_all_authors_and_images(spark):
    poems = spark.createDataFrame([(f"p{i}", i % 7, 4, 0.5, "song", f"a{i % 20:02}") for i in range(60)], "id string, chapter int, n_lines long, rhyme double, genre string, author string")
    images = spark.createDataFrame([(f"p{i}", f"t{k}", 10 - k) for i in range(60) for k in range(10)], "id string, term string, n int")
    whole = [(r["author"], r["poems"], r["images"]) for r in verse.poet_stats(poems, images, ["riddle"], k=None, top=None).collect()]
    assert whole == [(f"a{a:02}", 3, ",".join(f"t{k}" for k in range(10))) for a in range(20)]
    cut = [(r["author"], r["images"]) for r in verse.poet_stats(poems, images, ["riddle"]).collect()]
    assert cut == [(f"a{a:02}", ",".join(f"t{k}" for k in range(8))) for a in range(16)]


def test_query_has_every_poet(spark):
    poems = [r for r in collation_queries.poems(spark, SF).collect() if r["genre"] != "riddle" and r["author"]]
    own = defaultdict(list)
    for r in poems:
        own[r["author"]].append(r)
    got = registry.QUERIES["poet_stats"](spark, SF).collect()
    assert len(own) > 16 and [r["author"] for r in got] == sorted(own, key=lambda a: (a.startswith("（"), -len(own[a]), a))
    for r in got:
        mine = own[r["author"]]
        lines, text = sum(max(1, p["n_lines"]) for p in mine), "".join(p["text"] for p in mine)
        letters = sum(map(str.isalpha, text))
        used = Counter({t: sum(p["text"].count(t) for p in mine) for t in ("on", "er", "la")})
        assert (r["poems"], r["lines"], r["images"]) == (len(mine), lines, ",".join(sorted((t for t in used if used[t]), key=lambda t: (-used[t], t))))
        near = lambda x: pytest.approx(x, abs=1e-6)
        assert (r["mean_lines"], r["mean_rhyme"], r["mean_line_len"]) == (near(lines / len(mine)), near(sum(p["rhyme"] for p in mine) / len(mine)), near(len(text) / lines))
        assert (r["soft"], r["hard"]) == (near(sum(map(text.count, "aeiou")) / letters), near(sum(map(text.count, "kt")) / letters))
        assert (r["n_chapters"], r["first"], r["last"]) == (len({p["chapter"] for p in mine}), min(p["chapter"] for p in mine), max(p["chapter"] for p in mine))
