import pytest
from pyspark.sql import functions as F

from codexweave.functions import helpers
from codexweave.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("numeral", "value"), [("十", 10), ("二十", 20), ("十二", 12), ("一百二十", 120), ("一○一", 101), ("二三十", 25), ("一千零五", 1005), ("junk", None), ("", None)])
def test_numerals(spark, numeral, value):
    assert one(spark, tx.parse_numeral("t"), t=numeral) == value


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20, 101, 110, 999, 1005, 1200, 9999])
def test_numerals_round_trip(spark, n):
    assert one(spark, tx.parse_numeral(tx.format_numeral("n")), n=n) == n


def test_keep_chars_and_null(spark):
    assert one(spark, tx.keep_chars("t", punctuation="。"), t="寶玉abc，笑道。") == "寶玉笑道。"
    assert one(spark, tx.keep_chars("t"), t=None) is None


def test_variants_are_idempotent_and_take_astral_characters(spark):
    once = tx.normalize_variants("t", {"寳": "宝", "𠮷": "吉"}, [("甚麽", "什么")])
    assert one(spark, once, t="寳玉甚麽𠮷") == "宝玉什么吉"
    assert one(spark, tx.normalize_variants(once, {"寳": "宝", "𠮷": "吉"}), t="寳玉甚麽𠮷") == "宝玉什么吉"


def test_titles(spark):
    assert one(spark, tx.extract_title("t", "n"), t="序\n第十二回　王熙凤毒设相思局\n话说", n=12) == "王熙凤毒设相思局"
    assert one(spark, tx.extract_title("t", "n"), t="第十二回 某某", n=13) == ""
    assert one(spark, tx.fix_title("t"), t=" 甄士隐　梦幻  识通灵 ") == "甄士隐 梦幻 识通灵"
    assert one(spark, tx.fix_title("t"), t="短【】") == ""


def test_markers(spark):
    m = one(spark, tx.decode_markers("t", {"甲": "甲戌", "庚": "庚辰"}, {"眉": "眉批"}, F.lit("red"), {"red": "朱"}), t="甲眉庚")
    assert (m["editions"], m["kind"], m["ink"]) == (["甲戌", "庚辰"], "眉批", "朱")


def test_inline_annotations(spark):
    got = one(spark, tx.harvest_annotations("t", ["甲戌", "庚辰"], ["夹批", "侧批"], "庚辰"), t="正文【甲戌侧批：妙】后【无头】")
    assert [(a["editions"], a["kind"], a["text"]) for a in got] == [(["甲戌"], "侧批", "妙"), (["庚辰"], None, "无头")]


def test_sentences(spark):
    assert one(spark, tx.split_sentences("t"), t="他来了。“去罢！”好") == ["他来了", "“去罢", "”好"]
    assert one(spark, tx.split_sentences("t", keep=True), t="他来了。“去罢！”好") == ["他来了。", "“去罢！”", "好"]
    assert one(spark, tx.split_sentences("t"), t="") == []


def test_clauses(spark):
    got = one(spark, tx.split_clauses("t", function_chars="之", rhyme={"光": "ang"}), t="黛玉道：床前之明月光，\n疑是")
    assert [(c["speaker"], c["body"], c["length"], c["rhyme"]) for c in got][-2:] == [("", "床前之明月光", 6, "ang"), ("", "疑是", 2, "是")]


def test_counts_do_not_overlap(spark):
    assert one(spark, tx.count_term("t", "aa"), t="aaaaa") == 2
    assert one(spark, tx.lexicon_count("t", ["她", "她们"]), t="她们她") == 3
    assert one(spark, tx.class_density("t", "之", 1.0), t="") == 1.0
    assert one(spark, tx.density("t", ["之"]), t="") == 0.0


def test_snippets(spark):
    assert one(spark, tx.snippet("t", F.lit(2), 2, pad=1), t="abcdef") == "b〔cd〕e"
    assert one(spark, tx.truncate_at_sentence("t", 6), t="一二三。四五六七") == "一二三。"
    assert one(spark, tx.truncate_at_sentence("t", 6), t="一。三四五六七八") == "一。三四五六"


def test_chains_and_ranges(spark):
    assert one(spark, tx.parse_chain("t"), t="贾母→宝玉／黛玉（赠）→晴雯") == [["贾母"], ["宝玉", "黛玉"], ["晴雯"]]
    assert one(spark, tx.chapter_range("t"), t="第3-5回") == [3, 4, 5]
    assert one(spark, tx.chapter_range("t"), t="第76-75") == [76]
    assert one(spark, tx.chapter_range("t"), t="无") == []


def test_rules_and_tags(spark):
    assert one(spark, tx.classify("t", [("cold", "冷|雪"), ("warm", "花")], "neutral"), t="雪花") == "cold"
    assert one(spark, tx.multi_tags("t", {"a": ["x"], "b": ["y"]}, "o"), t="xy") == ["a", "b"]
    assert one(spark, tx.multi_tags("t", {"a": ["x"]}, "o"), t="z") == ["o"]


def test_html_and_wikitext(spark):
    assert one(spark, tx.html_to_text("t"), t="<p>A&amp;B</p><style>x</style><p>C<br>D</p><!-- no -->") == "A&B\nC\nD\n" or one(spark, tx.html_to_text("t"), t="<p>A&amp;B</p><p>C</p>").startswith("A&B\nC")
    assert one(spark, helpers.wikitext_to_text("t"), t="'''a''' [[b|c]] {{x|short|{{y|the longest}}|k=v}}<ref>r</ref>\n== H ==") == "a c the longest\nH"


def test_noise_lines(spark):
    assert one(spark, tx.strip_noise_lines("t"), t="标题在此\n 12 \n短\n正文一行") == "标题在此\n正文一行"
    assert one(spark, tx.strip_body("t", 5), t="头\n这一行够长了\n尾") == "这一行够长了\n尾"


def test_grams(spark):
    assert one(spark, tx.grams_of("t", 3), t="𠮷一二三") == ["𠮷一二", "一二三"]
    assert one(spark, tx.grams_of("t", 3), t="一") == []


def test_common_substring():
    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        want = max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
        assert helpers.common_substring(a, b) == want


def test_character_references(spark):
    cases = {"a&amp;lt;b": "a&lt;b", "&#20013;&#x6587;&#X1F600;": "中文😀", "&eacute;&apos;&nosuch;&": "é'&nosuch;&", "&#0;&#xD800;&#1114112;": "&#0;&#xD800;&#1114112;", "plain": "plain", "": "", "&Eacute;;&lt": "É;&lt"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "raw string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", tx.unescape("raw").alias("got")).collect())
    page = spark.createDataFrame([("<p>a&#8203;b&nbsp;&#160; c</p><p>d</p>",)], "h string").select(tx.html_to_text("h")).first()[0]
    assert page == "ab c\nd\n"
