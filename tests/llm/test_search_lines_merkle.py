"""Ranked lexical search, line dedup and Merkle manifests against plain versions."""

import random

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from codexweave.llm import lexical_search, line_dedup, merkle
from codexweave.llm.queries import LOWER, QUERIES, UPPER

DOCS = "doc_id long, text string"


def clash(df, *names):
    """df with columns more, whatever their names."""
    return df.select("*", *[F.lit("no").alias(f"more{i}") for i in range(len(names))]).toDF(*df.columns, *names)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def ranked(df):
    return sorted(map(tuple, df.collect()), key=repr)


def items_of(texts, rng):
    some = [(i, " ".join(rng.sample((t or "x").split() or ["x"], k=min(9, len((t or "x").split() or ["x"]))))) for i, t in enumerate(texts)]
    return some + [(70, None), (71, "  ..  "), (72, "absent terms only zzz"), (3, "more terms OF item three ünïcödé"), (None, "the dog and der Hund"), (None, "le chat")]


@pytest.mark.parametrize("block_bytes", [1 << 18, 300])
def test_search_matches_the_plain_version(spark, docs, texts, block_bytes):
    items = items_of(texts, random.Random(1))
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(got) == sorted(brute.ranked_search(pairs(docs), items), key=repr)


def test_search_ties_copies_null_ids_and_odd_columns(spark):
    rng = random.Random(2)
    base = prose(rng, 30)
    rows = [(i * 37 % 501, base) for i in range(400)] + [(None, base), (7, base + " and more words"), (900, base.upper()), (901, "other words here")]
    d = clash(spark.createDataFrame(rows, DOCS), "__k", "n", "Text", "terms").repartition(5)
    q = spark.createDataFrame([("a", base, 1), ("b", base.split()[0], 2), ("a", base, 1)], "item_id string, text string, score int")
    assert ranked(lexical_search.search(d, q)) == sorted(brute.ranked_search(rows, [("a", base), ("b", base.split()[0])]), key=repr)


def test_search_empty_tables(spark, docs, empty):
    q = spark.createDataFrame([(1, "word one")], "item_id long, text string")
    assert lexical_search.search(empty, q).count() == 0
    none = lexical_search.search(docs, q.filter("false"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("seed", range(4))
def test_shared_nodes_give_the_sums_of_their_terms(seed):
    rng = np.random.default_rng(seed)
    n_terms, n_items = 60, 40
    sets = [np.unique((rng.random(rng.integers(1, 30)) ** 3 * n_terms).astype(int)) for _ in range(n_items)]
    starts = np.append(0, np.cumsum([len(s) for s in sets]))
    plan = lexical_search.share(np.concatenate(sets), starts, n_terms)
    assert len(plan.nodes) < 0.7 * starts[-1]  # items share work
    item_of = np.repeat(np.arange(n_items), np.diff(np.append(plan.starts, len(plan.nodes))))
    serves = [set(item_of[plan.nodes == k]) for k in range(n_terms + len(plan.left))]
    for k in reversed(range(len(plan.left))):  # a node serves the items of the nodes made of it
        for part in (plan.left[k], plan.right[k]):
            serves[part] |= serves[n_terms + k]
    assert all(len(s) > 1 for s in serves[n_terms:])
    term, doc = np.nonzero(rng.random((n_terms, 17)) < 0.3)
    value = rng.integers(1, 1000, len(term))
    dense = np.zeros((n_terms, 17), np.int64)
    dense[term, doc] = value
    want = np.stack([dense[s].sum(axis=0) for s in sets])
    assert (lexical_search.accumulate(plan, n_terms, term, doc, value, 17) == want).all()


def test_long_documents_are_scaled_without_overflow():
    n = np.array([1, 10**7, 3 * 10**7])
    assert lexical_search.scale(n, 10**11, 10**14).tolist() == [10 + 90 * int(k) * 10**11 // 10**14 for k in n]


def lined(rng, n_docs, common, distinct):
    rows = []
    for i in range(n_docs):
        lines = [prose(rng, 3) for _ in range(rng.randint(0, 4))] + [rng.choice(["", " \t"])]
        for line, share in common:
            if rng.random() < share:
                lines.append(rng.choice([line, line.upper(), f" {line}\r"]))
                if rng.random() < 0.2:
                    lines.append(line)
        rng.shuffle(lines)
        rows.append((i if distinct else rng.choice([i, i, i, -i, 5, None]), "\n".join(lines)))
    return rows + rows[:15] + [(1001, None), (1002, ""), (1003, "\n\n"), (1004, "x" * 50000 + "\n" + " " * 50000)]


@pytest.mark.parametrize("min_docs, min_chars, keep_first, parts", [(10, 1, False, 4), (10, 1, False, 37), (2, 3, False, 5), (1, 1, True, 4), (10, 1, True, 37), (3, 1, True, 11)])
def test_lines_match_the_plain_version(spark, min_docs, min_chars, keep_first, parts):
    rng = random.Random(min_docs * 100 + parts)
    rows = lined(rng, 300, [("one licence line", 0.9), ("zweite Zeile", 0.4), ("é É", 0.1), ("rare", 0.03), ("b", 0.03)], keep_first)  # of documents with one id the first is that of the least hash
    d = clash(spark.createDataFrame(rows, DOCS), "keep", "th", "TEXT", "lines").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # one line's documents then fill many ranges
    try:
        got = sorted(map(tuple, line_dedup.remove_lines(d, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted(brute.line_dedup(rows, min_docs, min_chars, keep_first), key=repr)


def test_lines_of_messy_texts(spark, docs, empty):
    for n in (1, 2, 3):
        got = sorted(map(tuple, line_dedup.remove_lines(docs, min_docs=n).collect()))
        assert got == sorted(brute.line_dedup(pairs(docs), n))
    assert line_dedup.remove_lines(empty).count() == 0 and line_dedup.bitmaps(empty).count() == 0


def test_bitmaps_say_which_lines_stay(spark):
    rows = [(i, f"own {i}\nShared\n\nshared \nown {i} too") for i in range(12)] + [(20, "nothing shared")]
    maps = {r["id"]: r for r in line_dedup.bitmaps(spark.createDataFrame(rows, DOCS)).collect()}
    assert sorted(maps) == list(range(12))
    assert line_dedup.unpack(maps[3]["keep"]).tolist() == [True, False, True, False] and maps[3]["n_dropped"] == 2


def fields(rng, n):
    names = [None, "", "a", "B", "é", "zz", "one"]
    rows = [(i * 13 % 997 - 50, names[min(6, int(rng.random() ** 3 * 7))] if i else "lone", rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Text A", "ÄB c", f"Row {i}"])) for i in range(n)]
    return [*rows, (None, "a", "en", 1, "Null ID")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def checked(d, fanout=16):
    made = merkle.manifest(d, tampered={"text": F.translate("text", UPPER, LOWER)}, changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout=fanout)
    return made, merkle.check(made.proofs)


@pytest.mark.parametrize("n, fanout", [(1, 16), (40, 2), (700, 16), (300, 3)])
def test_manifest_matches_the_plain_version(spark, n, fanout):
    rows = fields(random.Random(n), n)
    d = clash(spark.createDataFrame(rows, SCHEMA), "grp", "h", "pos", "TEXT", "path").repartition(5)
    made, out = checked(d, fanout)
    want = brute.merkle(rows, fanout)
    got = {(r["id"], r["leaf"]): tuple(r)[2:] for r in out.collect()}
    assert got == {(k[0], v[0]): v[1:] for k, v in want.items()}
    assert 0 < sum(not v[-1] for v in want.values()) < len(want) or n == 1
    nodes = {(r["tree"], r["grp"], r["level"], r["pos"]): r["digest"] for r in made.nodes().collect()}
    assert sum(k[0] == "group" and k[2] == 0 for k in nodes) == len(rows)
    assert {v[1] for v in want.values()} == {nodes[k] for k in nodes if k[0] == "upper" and k[2] == 0}


def test_manifest_of_repeated_rows_one_group_and_nothing(spark):
    rows = [(5, "a", "en", 1, "same Text")] * 40 + [(5, "a", "en", 1, "another")] * 3
    got = [tuple(r) for r in checked(spark.createDataFrame(rows, SCHEMA))[1].collect()]
    assert len(got) == 43 and len({r[2:4] for r in got}) == 1 and all(r[2] == r[3] for r in got)
    assert len({r[4] for r in got}) > 3 and {r[6] for r in got} == {True}  # crc32 of "5" leaves these rows as they are
    made, out = checked(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and made.nodes().count() == 0
    lone = checked(spark.createDataFrame([(2, None, None, None, None)], SCHEMA))[1].collect()[0]
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] == brute.HEX("1:2----") and lone["proof_sha256"] == brute.HEX("")


def test_queries_give_whole_results(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [(r[0], r[4]) for r in docs]
    by_name = {name: f(spark, sf).collect() for name, f in QUERIES.items() if name[:4] in ("op11", "op12", "op13")}
    assert ranked_rows(by_name["op11_lexical_search"]) == sorted(brute.ranked_search(texts, items))
    assert sorted(map(tuple, by_name["op12_line_dedup"])) == sorted((d, n, k, brute.HEX(t)) for d, n, k, t in brute.line_dedup(texts))
    assert {r["doc_id"]: tuple(r)[1:] for r in by_name["op13_merkle_manifest"]} == {k[0]: v for k, v in brute.merkle(docs).items()}


def ranked_rows(rows):
    return sorted(map(tuple, rows))
