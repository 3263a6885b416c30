import gzip
import hashlib
import random

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from codexweave.llm import bpe, decontamination, language_id, near_dedup, pii, quality_rules, secrets, substring_dedup, token_counts, warc
from codexweave.llm.common import sha256
from codexweave.llm.components import components
from codexweave.llm.queries import ORACLES, QUERIES, tokenizer_path

PIECE, WORD = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_secrets_match_the_plain_version(docs, empty):
    got = by_id(secrets.digests(secrets.scan(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"))
    assert got == {i: brute.secrets(t) for i, t in pairs(docs)}
    assert secrets.digests(secrets.scan(empty)).count() == 0


def test_secrets_ownership_and_redaction(spark):
    live, common = "q7Zr81kLm2x9", "Samp1eKey99x"
    rows = [(1, f"token={live} here", "a"), (2, f"token={common} here", "a"), (3, f"token={common}", "b"), (4, f"token={common}", "c"), (5, f"key {live}q7Zr81kLm2x9 and token={live}q7Zr81kLm2x9", "a"), (6, f"bare {live}q7Zr81kLm2x9 again", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanned = secrets.scan(d)
    spans = {r["id"]: [(s["kind"], s["verdict"]) for s in r["spans"]] for r in scanned.collect()}
    assert spans[1] == [("assign", "live")]
    assert spans[2] == [("assign", "copied")]
    assert ("bare", "live") in spans[6] and ("bare", "live") in spans[5]
    masked = by_id(secrets.redact(d, scanned).select("doc_id", "text"))
    assert masked[1] == ("[SECRET] here",) and masked[2] == (f"token={common} here",) and masked[6] == ("bare [SECRET] again",)


def test_substring_dedup_matches_the_plain_version(spark, docs, empty):
    out = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", sha256(F.col("kept")))
    assert by_id(out) == {x[0]: x[1:] for x in brute.substring_dedup(pairs(docs))}
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_random_repeats(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(45, 120)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        rows.append((rng.randint(-5, 1000) * 10 + i % 10, " ".join(parts)))
    rows = list(dict(rows).items())
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(d).select("doc_id", "n_words", "n_removed", sha256(F.col("kept")))
    assert by_id(out) == {x[0]: x[1:] for x in brute.substring_dedup(rows)}


def test_token_counts_match_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in pairs(docs)}
    for chunk, overlap in ((1 << 15, 1 << 10), (200, 8), (64, 2)):
        got = token_counts.count_tokens(docs, PIECE, chunk_chars=chunk, overlap_chars=overlap)
        assert by_id(got.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == want
    assert token_counts.count_tokens(empty, PIECE).count() == 0


def test_token_splices_are_exact_on_random_texts():
    s = token_counts.splitter(PIECE)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abcde  \n.é漢😀") for _ in range(rng.randint(0, 900)))
        assert s.count(text, rng.randint(20, 120), rng.randint(1, 30))[0] == s.count_whole([text])[0]


def test_near_classes_hold_all_pairs(spark, docs, empty):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        words = prose(rng, rng.randint(6, 260)).split()
        for c in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (None, "null id"), (0, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dedup.classes(d).collect()]
    assert len(got) == len(rows)
    label = {i: c for i, c, _ in got if i is not None}
    shingle_sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, t in rows if i is not None and t for w in [t.split()]}
    ids = sorted(shingle_sets)
    for x in ids:
        for y in ids:
            j = len(shingle_sets[x] & shingle_sets[y]) / len(shingle_sets[x] | shingle_sets[y])
            if j >= 0.83:
                assert label[x] == label[y]
            if j == 0 and x != y:
                assert label[x] != label[y] or any(label[x] == label[z] for z in ids if z not in (x, y))
    assert all(c <= i for i, c in label.items())
    assert near_dedup.classes(empty).count() == 0
    kept = near_dedup.keep_one(d.filter("doc_id is not null"), near_dedup.classes(d))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for i, c in label.items()})


def test_near_classes_hold_pairs_below_a_shared_template(spark):
    """Texts with a common template, similar at 0.78, and among them pairs at 0.81: most of their buckets hold hundreds of classes."""
    rng = random.Random(11)
    template = prose(rng, 238)
    own = lambda n: " ".join(f"w{rng.getrandbits(48)}" for _ in range(n))
    rows = [(i, f"{template} {own(25)}") for i in range(1000)]
    for i in range(1000, 1120, 2):
        common = own(4)
        rows += [(i, f"{template} {common} {own(21)}"), (i + 1, f"{template} {common} {own(21)}")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 1000 else i - i % 2 for i, _ in rows}


def test_samples_follow_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    w = rng.uniform(1, 3, 4000)
    a, b = np.arange(0, 3400), np.arange(400, 4000)
    agree = (near_dedup.samples(h[a], np.zeros(len(a), np.int64), w[a], 1) == near_dedup.samples(h[b], np.zeros(len(b), np.int64), w[b], 1)).mean()
    true = w[400:3400].sum() / w.sum()
    assert abs(agree - true) < 0.12


def test_components_are_those_of_union_find(spark):
    rng = random.Random(4)
    links = list({(rng.randrange(80), rng.randrange(80)) for _ in range(60)})
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_quality_matches_the_plain_version(docs, empty):
    out = quality_rules.assess(docs)
    got = by_id(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == {i: brute.quality(t) for i, t in pairs(docs)}
    assert out.filter("kept and base_failed").count() == 0
    assert quality_rules.assess(empty).count() == 0


def test_cascade_verdict_does_not_depend_on_the_order(texts):
    import pyarrow as pa

    s = quality_rules.statistics(texts, *quality_rules.text_buffer(pa.array(texts, pa.large_string())))
    names = [r.name for r in quality_rules.RULES]
    first = quality_rules.cascade(texts, s, names)[0]
    assert (quality_rules.cascade(texts, s, names[::-1])[0] == first).all()
    slow = quality_rules.Rule("slow", lambda t, s: np.zeros(len(t), bool) if not [sum(range(20000)) for _ in t] else np.zeros(len(t), bool))
    keen = quality_rules.Rule("keen", lambda t, s: np.ones(len(t), bool))
    assert quality_rules.plan(["some words here"] * 20, (slow, keen)) == ["keen", "slow"]


def test_pii_matches_the_plain_version(docs, empty):
    got = by_id(pii.digests(pii.scan(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    assert got == {i: brute.pii(t) for i, t in pairs(docs)}
    assert pii.digests(pii.scan(empty)).count() == 0


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"text number is +1 436 555 86{i:02d} end") for i in range(6)] + [(50, "the number is ABC-99812-X today"), (51, "other word 77812-Z here")]
    spans = {r["id"]: [s["kind"] for s in r["spans"]] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[50] == ["ctx_phone"] and spans[51] == [] and spans[0] == ["phone"]


def test_bpe_matches_the_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want = {}
    for i, text in pairs(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert by_id(bpe.encode_digests(docs, WORD)) == want
    assert bpe.encode_digests(empty, WORD).count() == 0


def test_bpe_on_odd_strings():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(WORD), bpe.encoder(WORD), random.Random(6)
    odd = ["<|endoftext|>a<|startoftext|>", "don't WE'LL x'S", "ΑΣ ς Σ", "½ ⅷ ² ª", "a\x1cb\x85c", "漢字かな", "ȩ́"]
    odd += ["".join(rng.choice("abehilnorst '’é.!19βΣ😀<|>") for _ in range(rng.randint(1, 50))) for _ in range(400)]
    for text in odd:
        ids = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == ids
        assert e.both(text)[1] == t.decode(ids, skip_special_tokens=False)


def test_language_id_learns_and_rejects(spark, docs, empty):
    sentences = {"en": "the cat and the dog were in the house with a bird", "de": "der hund und die katze waren im haus mit einem vogel", "fr": "le chat et le chien dans la maison avec un oiseau"}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.sample(s.split(), len(s.split())) * 3), lang) for i in range(40) for lang, s in sentences.items()]
    content = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(content) == set(sentences)
    tests = spark.createDataFrame([(lang, s.upper()) for lang, s in sentences.items()] + [("und", None), ("und", "123 !"), ("und", "")], "doc_id string, text string")
    got = language_id.identify(tests, content).collect()
    assert all(r["doc_id"] == r["lang_pred"] for r in got)
    assert all(r["rejected"] and r["score"] == 0 for r in got if r["doc_id"] == "und")
    assert all(0 <= r["score"] <= 1 for r in language_id.identify(docs, content).collect())
    assert language_id.train(empty) == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_language_id_learns_every_language(spark):
    """150 languages, each with its own words: those with few rows are learned as well."""
    rng = random.Random(9)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(150)}
    rows = [(k, " ".join(rng.sample(w, 12)), lang) for lang, w in words.items() for k in range(2 if lang < "l080" else 1)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    content = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(content) == set(words)
    tests = spark.createDataFrame([(lang, " ".join(rng.sample(w, 12))) for lang, w in words.items()], "doc_id string, text string")
    got = language_id.identify(tests, content).collect()
    assert len(got) == 150 and all(r["doc_id"] == r["lang_pred"] and not r["rejected"] for r in got)


def test_language_id_held_out_accuracy(spark):
    out = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 30").select("doc_id", "lang")
    right = out.filter("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_decontamination_matches_the_plain_version(spark, docs, empty):
    texts = [t for _, t in pairs(docs)]
    items = [(1, " ".join((texts[5] or "x").split()[3:40])), (2, "A B-C"), (3, None), (4, ""), (5, "unseen words only " * 5), (None, "one"), (6, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {x[0]: x[1:] for x in brute.contamination(pairs(docs), [i for i in items if i[0] is not None])}
    for limit in (1 << 20, 40):  # one block, several blocks
        found = decontamination.decontaminate(docs, bench, block_bytes=limit)
        n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
        got = by_id(found.select("doc_id", "n_words", n_hit, F.size("items"), sha256(F.concat_ws(",", F.array_sort("items"))), n_hit > 0))
        assert got == want
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_decontamination_segments(monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 37)
    rng = random.Random(8)
    text = prose(rng, 400)
    w = text.split()
    s = decontamination.Searcher([("a", " ".join(w[100:125])), ("b", " ".join(w[390:400])), ("c", w[7])], 10)
    n, spans, items = s.search(text)
    want = brute.contamination([(0, text)], [("a", " ".join(w[100:125])), ("b", " ".join(w[390:400])), ("c", w[7])])[0]
    assert (n, sum(hi - lo for lo, hi in spans), len(items)) == want[1:4]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 700 + "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(1, "http://www.a.example.com/x?q#f", big), (2, "http://b.example.com/", big), (3, None, "small"), (4, "http://a.example.com/x?q", "small"), (9, "http://c d.example/\r\n", big), (5, "x", None), (6, "", ""), (None, "http://n.example", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, f"{tmp_path}/w", segment_bytes=1500)
    read = warc.read_archives(spark, f"{tmp_path}/w")
    index = warc.merge_index(read, partitions=3).collect()
    keys = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in index]
    assert keys == sorted(keys) and len(index) == len(rows)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index}
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 9
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)
    one = index[3]
    raw = gzip.decompress(open(one["run"].removeprefix("file:"), "rb").read())
    assert raw[one["at"] : one["at"] + 8] == b"WARC/1.1" and raw[one["at"] + one["length"] - 4 : one["at"] + one["length"]] == b"\r\n\r\n"
    assert warc.merge_index(warc.read_archives(spark, f"{tmp_path}/w").limit(0), 2).count() == 0


def test_loser_tree_merges():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def test_null_ids_and_repeated_rows(spark):
    rng = random.Random(11)
    text = prose(rng, 120) + " token=abcdef123456"
    d = spark.createDataFrame([(None, text), (3, text), (3, text), (1, text), (None, None)], "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    cut = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(d).collect())
    assert cut == [(0, 0), (0, 0), (1, 0), (3, 121), (3, 121)]
    classed = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in near_dedup.classes(d).collect())
    assert classed == [(0, 0), (0, 0), (1, 1), (3, 1), (3, 1)]
    assert sorted(r["doc_id"] or 0 for r in near_dedup.keep_one(d, near_dedup.classes(d)).collect()) == [0, 0, 1]
    assert sorted(r["n_assign"] for r in secrets.digests(secrets.scan(d)).collect()) == [0, 1, 1, 1, 1]
    assert pii.digests(pii.scan(d)).count() == 5 and bpe.encode_digests(d, WORD).count() == 5
    assert token_counts.count_tokens(d, PIECE).count() == 5 and quality_rules.assess(d).count() == 5
    assert language_id.identify(d, language_id.train(d)).count() == 5
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontamination.decontaminate(d, bench).filter("size(items) = 1").count() == 4
