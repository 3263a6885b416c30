"""Cases that single out a rule of a contract, and measurements of the methods."""

import random
import unicodedata

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from codexweave.llm import bpe, common, decontamination, language_id, near_dedup, pii, quality_rules, secrets, token_counts, warc
from codexweave.llm.queries import tokenizer_path

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def test_bpe_splits_and_folds_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(WORD), bpe.encoder(WORD)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 14):
        text = " ".join(f"a{chr(c)}b{chr(c)}{chr(c)}" for c in points[at : at + (1 << 14)])
        want = [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]
        assert [w.encode().decode("latin-1").translate(e.bytes) for w in e.words(text)] == want
    special = " ".join(f"x{chr(c)}y" for lo, hi in bpe._runs(bpe.NEW_LETTERS + " " + bpe.NEW_NUMBERS) for c in (lo, hi))
    assert e.encode(special) == t.encode(special, add_special_tokens=False).ids


def test_every_part_of_an_address_is_judged(spark):
    texts = ["1001.2.3.4", "1.2.3.0256", "1.2.3.0255", "0000255.0.00.1", "1.2.3.1001", "256.1.1.1", "1.1.1." + "0" * 30 + "7", "1.1.1." + "9" * 30, "1.2.3.4.5.6.7.8", "255.255.255.255"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii.digests(pii.scan(d)).collect()}
    assert got == {i: brute.pii(t) for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(len(texts))] == [0, 0, 1, 1, 0, 0, 1, 0, 2, 1]


def test_contexts_find_groups_of_digits_and_words_with_at(spark):
    rows = [(i, f"call phone +1 436 555 86{i:02d} or mail ab{i}@c.de now") for i in range(6)]
    rows += [(50, "call phone (555) 123-4567 today"), (51, "now ipv4 phone 555 123 4567."), (52, "or mail jane@intranet please"), (53, "12 345 other 555 123 4567 things"), (54, "phone 1.2.3.4 is an address")]
    spans = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[50] == [("ctx_phone", 11, 25)] and spans[51] == [("ctx_phone", 15, 27)]
    assert spans[52] == [("ctx_email", 8, 21)] and spans[53] == [] and spans[54] == [("ip", 6, 13)]


def test_secrets_by_repository_and_as_part_of_a_word(spark):
    live, wide = "q7Zr81kLm", "W7ide5Value9"
    rows = [(1, f"token={live}.", "a", "r1"), (2, f"AUTH={live} and /path/{live} and {live}.", "b", "r1"), (3, "the long word " + live + "x", "b", "r1")]
    rows += [(10 + i, f"token={wide}", "a", f"r{i}") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    found = secrets.digests(secrets.scan(d, repository=("repo",)))
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[1]["spans"] == "assign:0:16" and got[1]["n_live"] == 1
    assert got[2]["spans"] == "bare:5:14,bare:25:34,bare:39:48" and got[3]["spans"] == ""
    assert got[10]["n_copied"] == 1 and got[10]["most_repositories"] == 8 and got[10]["most_owners"] == 1
    assert {r["doc_id"]: r["n_live"] for r in secrets.digests(secrets.scan(d)).collect()}[10] == 1  # by owner alone it is one owner's


def pairs_at(rng, n, low, high):
    """Pairs of texts that differ in a few words, and their plain shingle similarity at least `low`."""
    out = []
    while len(out) < n:
        a = prose(rng, rng.randint(60, 400)).split()
        b = list(a)
        for _ in range(max(1, round(len(a) * rng.uniform(0.012, 0.03)))):
            b[rng.randrange(len(b))] = f"w{rng.getrandbits(40)}"
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        if low <= len(x & y) / len(x | y) <= high:
            out.append((" ".join(a), " ".join(b)))
    return out


def weights_of(texts, share=0.3):
    data, offsets = near_dedup.text_buffer(pa.array(texts, pa.large_string()))
    hash_, doc, _ = near_dedup.shingles(data, offsets, 5)
    key = np.unique((doc.astype(np.int64) << 20) | near_dedup.cell_of(hash_))
    df = np.bincount(key & (near_dedup.CELLS - 1), minlength=near_dedup.CELLS)
    return hash_, doc, near_dedup.idf_weights(df, len(texts), share)


def similarities(texts, pairs, weights, hash_, doc):
    low = (hash_ & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    of = [np.sort(low[doc == i]) for i in range(len(texts))]
    return [near_dedup.weighted_jaccard(of[a], of[b], weights) for a, b in pairs]


def test_one_sample_a_bin_agrees_as_often_as_the_texts_are_similar():
    """The share of equal samples estimates the weighted Jaccard similarity: no bias, and the spread of 240 draws at most."""
    rng = random.Random(21)
    texts = [t for p in pairs_at(rng, 150, 0.55, 0.95) for t in p]
    hash_, doc, weights = weights_of(texts)
    true = np.array(similarities(texts, [(i, i + 1) for i in range(0, len(texts), 2)], weights, hash_, doc))
    h, d, n = near_dedup.counted(hash_, doc)
    s = near_dedup.samples(h, d, n * weights[near_dedup.cell_of(h)], len(texts))
    error = (s[::2] == s[1::2]).mean(1) - true
    assert abs(error.mean()) < 0.01 and error.std() < 0.05


def test_near_dedup_recall_against_brute_force_at_the_threshold(spark):
    """Every pair of weighted similarity 0.8 or more, most of them just above it, is found; none below is linked."""
    rng = random.Random(22)
    texts = [t for p in pairs_at(rng, 300, 0.72, 0.9) for t in p]
    hash_, doc, weights = weights_of(texts)
    sims = similarities(texts, [(i, i + 1) for i in range(0, len(texts), 2)], weights, hash_, doc)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = [i for i, s in enumerate(sims) if s >= 0.8]
    assert len(near) > 60
    assert sum(got[2 * i] == got[2 * i + 1] for i in near) / len(near) >= 0.99
    assert not any(got[2 * i] == got[2 * i + 1] for i, s in enumerate(sims) if s < 0.8)


def test_near_dedup_one_id_with_several_texts(spark):
    rng = random.Random(23)
    a, b = prose(rng, 80), prose(rng, 80)
    d = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a)], "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in near_dedup.classes(d).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5)]
    assert sorted((r["doc_id"], r["text"] == a) for r in near_dedup.keep_one(d, near_dedup.classes(d)).collect()) == [(3, False), (5, False), (5, True)]


def test_hot_keys_are_dealt_out_without_change(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_KEY", 10)
    rows = [(0, i) for i in range(300)] + [(i, i) for i in range(1, 60)] + [(None, 7)]
    left, right = spark.createDataFrame(rows, "k long, x long"), spark.createDataFrame([(i, f"v{i}") for i in range(50)] + [(None, "n")], "k long, v string")
    for how in ("inner", "left"):
        got = common.salted_join(left, right, ["k"], len(rows), how=how)
        assert sorted(map(repr, got.select("k", "x", "v").collect())) == sorted(map(repr, left.join(right, "k", how).select("k", "x", "v").collect()))


def test_language_ties_and_places_of_training_text(spark):
    text = "one two three four five six seven"
    rows = [(i, text, "aa" if i % 2 else "bb") for i in range(40)] + [(100, text, "aa")]
    content = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_lang=8)
    got = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), {k: content["aa"] for k in content}).first()
    assert list(content) == ["aa", "bb"] and got["lang_pred"] == "aa" and got["score"] == 0 and got["rejected"]
    long_ = " ".join(f"head{i}" for i in range(3000)) + " " + " ".join(f"tail{i}" for i in range(3000))
    of = language_id.train(spark.createDataFrame([(1, long_, "aa"), (1, long_ + "z", "aa"), (1, "other", "bb")], "doc_id long, text string, lang string"), docs_per_lang=4, dict_bytes=4096)
    assert b"head" in of["aa"] and b"tail" in of["aa"] and len(of["aa"]) <= 1024 + 3 and of["bb"] == b"other"


def test_warc_repeated_pages_and_kept_archives(spark, tmp_path):
    big = "<p>" + "x" * 2000 + "</p>"
    rows = [(4, "http://a.b/", big), (4, "http://a.b/", big), (2, "http://a.b/", big), (None, "http://a.b/", big), (3, "http://a.b/", big + "y"), (7, "u", None), (8, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.capture_index(pages, path=f"{tmp_path}/kept").collect())
    assert got == [(0, "revisit", 4), (2, "revisit", 4), (3, "response", 0), (4, "response", 0), (4, "response", 0), (7, "response", 0), (8, "response", 0)]
    assert warc.read_archives(spark, f"{tmp_path}/kept").count() == len(rows)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_benchmark_in_many_chains(spark):
    rng = random.Random(24)
    items = [(f"i{k}", prose(rng, 30)) for k in range(40)]
    rows = [(k, " ".join([prose(rng, 5), *(rng.choice(items)[1] for _ in range(k % 4)), prose(rng, 9)])) for k in range(30)] + [(3, None), (None, items[0][1]), (None, items[0][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted((x[0] or 0, *x[1:4]) for x in brute.contamination(rows, items))
    found = decontamination.decontaminate(d, b, block_bytes=700)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    assert sorted((r[0] or 0, *tuple(r)[1:]) for r in found.select("doc_id", "n_words", n_hit, F.size("items")).collect()) == want


def test_a_changing_normal_form_anywhere_stops_the_splicing(monkeypatch):
    s = token_counts.splitter(PIECE)
    text = " ".join(["plain words here"] * 200)
    assert s.plain(text) and sum(1 for _ in s.pieces(text, 300, 20)) > 1
    called = []
    monkeypatch.setattr(s, "plain", lambda t: "X" not in t)
    monkeypatch.setattr(s, "pieces", lambda *a: called.append(a) or iter([(0, 1, -1)]))
    assert s.count(text + " X", 300, 20) == (s.count_whole([text + " X"])[0], 0) and not called


def test_texts_of_a_hundred_chunks_are_spliced(spark):
    """Chunks begin anywhere: with spaces, line ends or the character by which the vocabulary writes a space."""
    rng = random.Random(8)
    texts = ["".join(rng.choice([" ", "  ", "\n", "▁", " ▁"]) + prose(rng, rng.randint(1, 9)) for _ in range(n)) for n in (60, 600, 2400)]
    s = token_counts.splitter(PIECE)
    for t in texts:
        chunk = len(t) // 100
        n, parts = s.count(t, chunk, 16)
        assert n == s.count_whole([t])[0] and parts >= 100
    d = spark.createDataFrame(list(enumerate([*texts, "short", None])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_chunked"] for r in token_counts.count_tokens(d, PIECE, chunk_chars=500, overlap_chars=16).collect()}
    assert got[0] > 1 and got[2] > got[1] > 10 and got[3] == got[4] == 0


def test_marks_are_ordered_and_composed_as_by_the_library():
    """Every mark beside marks of several classes, and every canonical pair of Python's tables."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(WORD), bpe.encoder(WORD)
    classes = {}
    marks = [c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M"]
    for m in marks:
        classes.setdefault(unicodedata.combining(m), m)
    beside = [classes[k] for k in (1, 220, 230, 240)]
    pairs_ = [unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x30000)) if unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c)]
    texts = [f"a{m}{x}b e{x}{m}" for m in marks for x in beside] + pairs_ + [f"{p}{beside[1]}{beside[2]}" for p in pairs_] + ["\U00011935\U00011930", "a\u07fd\u0334"]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert e.encode(text) == want.ids, text


def test_numbers_and_signs_are_no_letters(spark):
    rows = [(1, "Der Hund und die Katze " * 9, "de"), (2, "The dog and the cat " * 9, "en"), (3, "²½ 12", None), (4, "①Ⅷ _ 7", None), (5, "ª the dog", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, language_id.train(d)).collect()}
    assert got[3] == got[4] == "und" and got[5] != "und"


@pytest.mark.parametrize("first", [0x4E00, 0x20000])
def test_every_sampled_document_has_its_share_of_the_dictionary(spark, first):
    """Documents of a letter each, in scripts of three and four bytes a letter."""
    rows = [(i, chr(first + i) * (20 + i * 9), "x") for i in range(256)]
    content = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["x"]
    got = {c: content.decode().count(c) for c in {t[0] for _, t, _ in rows}}
    size = len(chr(first).encode())
    assert len(content) <= 1 << 17 and all(got[t[0]] >= min(len(t), 480 // size) for _, t, _ in rows)



@pytest.mark.parametrize("kept,text", [(True, "Ein Haus am See steht dort und ist alt, aber schön; der Hund läuft um das Haus und sucht seinen Ball im hohen Gras. " + " ".join(f"und {w}" for w in dir(str))), (False, " ".join(f"code{i}x{i * 7}" for i in range(300))), (True, "сегодня мы идём в лес и там мы видим дом и реку, и поле, и сад; " + " ".join(f"слово{'абвгдежзик'[i % 10]}{i} и" for i in range(120)))])
def test_prose_of_any_language_is_kept(spark, kept, text):
    assert quality_rules.assess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["kept"] is kept


def test_languages_match_the_plain_version(spark, docs):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    content = language_id.train(sf)
    some = docs.select("doc_id", "text").unionByName(sf.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in language_id.identify(some, content).collect())
    plain = [(r["doc_id"], *brute.language(r["text"], content)) for r in some.collect()]
    assert got == sorted((i, lang, round(score, 9), lang == "und" or score < 0.005) for i, lang, score in plain)
