import random
import re
import time

import pytest

from codexweave.functions import helpers
from codexweave.operators import collate


def table(a, b):
    """Longest common substring by the quadratic table."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            now[j] = before[j - 1] + 1 if x == y else 0
            best = max(best, now[j])
        before = now
    return best


def test_the_automaton_gives_the_table(spark):
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert helpers.common_substring(a, b) == table(a, b)


def test_long_sentences_take_linear_time():
    rng = random.Random(2)
    quote = "".join(rng.choice("ab") for _ in range(10_000))
    took = []
    for n in (10_000, 40_000):
        text = "a" * n + quote[3000:9000]
        began = time.perf_counter()
        assert helpers.Substrings(quote).longest_in(text) >= 6000
        took.append(time.perf_counter() - began)
    assert took[1] < 3 and helpers.Substrings("ab" * 5000).longest_in("ba" * 5000) == 9999


def plain(quotes, texts, least, share):
    out, turns = {}, {}
    for qid, key, quote in quotes:
        nets = [re.sub("[^a-z]", "", s) for s in re.findall(r"[^.!?]+[.!?]*", texts.get(key) or "") if s.strip(" ")]
        q, joined = re.sub("[^a-z]", "", quote or ""), "".join(nets)
        turns[key, q] = turns.get((key, q), 0) + 1
        if q and q in joined:
            hits, at = [], joined.find(q)
            while at >= 0:
                hits.append(at)
                at = joined.find(q, at + len(q))
            end, total = hits[min(turns[key, q], len(hits)) - 1] + len(q), 0
            for i, n in enumerate(nets):
                total += len(n)
                if total >= end:
                    out[qid] = (i, "exact")
                    break
        else:
            score = [table(q, n) for n in nets]
            best = max(score, default=0)
            ok = q and best >= max(least, int(len(q) * share))
            out[qid] = (score.index(best), "fuzzy") if ok else (None, "none")
    return out


@pytest.mark.parametrize("least, share, group", [(4, 0.6, 100), (4, 0.6, 2), (2, 0.3, 100), (6, 0.9, 3)])
def test_anchors_match_the_plain_search(spark, least, share, group):
    rng = random.Random(least)
    word = lambda n: "".join(rng.choice("aab c,") for _ in range(n))
    texts = {k: "".join(word(rng.randint(0, 25)) + rng.choice([".", "!", "?!", "."]) for _ in range(8)) for k in range(6)} | {7: None, 8: "", 9: "xyz"}
    quotes = []
    for i in range(90):
        key = rng.choice([*texts, 99])
        t = texts.get(key) or "aaaa"
        at = rng.randrange(len(t))
        quote = t[at : at + rng.randint(1, 16)]
        if rng.random() < 0.6 and len(quote) > 4:
            quote = quote[: len(quote) // 2] + rng.choice("zcab") + quote[len(quote) // 2 :]
        quotes.append((i, key, rng.choice([quote, quote, quote, None, word(7)])))
    quotes += [(100 + i, 3, quotes[5][2]) for i in range(4)]
    d = spark.createDataFrame(list(texts.items()), "k int, text string")
    q = spark.createDataFrame(quotes, "id int, k int, quote string")
    got = {r["id"]: (r["sentence"], r["how"]) for r in collate.anchor_quotes(q, d, "k", "id", "a-z", ".!?", least, share, group).collect()}
    want = plain(quotes, texts, least, share)
    assert got == want and {h for _, h in want.values()} >= {"exact", "none"}


def test_templates_from_the_outside_in():
    x = helpers.expand_templates
    assert x("{{a|[x|y]|b}}") == "[x|y]"  # a bar in brackets parts nothing
    assert x("{{Novel|a=1|prev=x}}t") == "t"
    assert x("{{outer|k={{inner|long named}}|short}}") == "short"
    assert x("{{o|{{i|one|longer one}}|{{j|mid}}}} and {{k|v}}") == "longer one and v"
    assert x("{{a|" * 8 + "deep" + "}}" * 8) == "deep"
    assert x("{{a|" * 9 + "deep" + "}}" * 9) == "{{a|deep}}"
    assert x("{{open|never closed") == "never clos" and x("a }} b") == "a }} b" and x("{{}}") == "" and x(None) is None
    assert x("{{lang|[[File:a|b]]|see [[c|d]] here}}") == "see [[c|d]] here"


def test_font_breaks_and_spaces(spark):
    raw = "<font color='red'>a</font><br>b<BR />c&nbsp;&nbsp;d<ref name=x/> {{p|[http://x.y label]|q}}\n\n\n\n[[A|B]] ''i''"
    df = spark.createDataFrame([(raw,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(helpers.wikitext_to_text("t")).collect()]
    assert got == ["a\nb\nc d label\n\nB i", None, ""]
