"""Collation of editions, verification and anchoring of quotations, ledgers of planted and fulfilled clues."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.helpers import Sentences
from .facts import small, term_hits
from .ordered import top_n


def collate_titles(chapters: DataFrame, streams: Sequence[str]) -> DataFrame:
    """chapter, one title column per stream, number of different valid titles (white space ignored), variant flag."""
    squeezed = F.nullif(F.regexp_replace("title", r"[\s　]", ""), F.lit(""))
    wide = chapters.groupBy("chapter").pivot("stream", list(streams)).agg(F.min("title"))
    n = chapters.groupBy("chapter").agg(F.count_distinct(squeezed).alias("n_titles"))
    return wide.join(n, "chapter").withColumn("differs", F.col("n_titles") > 1)


def edition_summary(chapters: DataFrame, char_class: str) -> DataFrame:
    """stream, chapters, class characters, first and last chapter."""
    n = F.length(tx.keep_chars("text", char_class))
    return chapters.groupBy("stream").agg(F.count("*").alias("chapters"), F.sum(n).cast("long").alias("chars"), F.min("chapter").alias("first"), F.max("chapter").alias("last"))


def length_diff(chapters: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """side, chapter, diff: where edition b is shorter (cut) or longer (added) than a, the k largest of each."""
    side = lambda s, n: chapters.filter(F.col("stream") == s).select("chapter", F.length("text").alias(n))
    d = side(a, "na").join(side(b, "nb"), "chapter").select("chapter", (F.col("nb") - F.col("na")).cast("long").alias("diff"))
    cut = d.filter("diff < 0").orderBy("diff", "chapter").limit(k).select(F.lit("cut").alias("side"), "chapter", "diff")
    return cut.unionByName(d.filter("diff > 0").orderBy(F.desc("diff"), "chapter").limit(k).select(F.lit("added").alias("side"), "chapter", "diff"))


def verify_quotes(quotes: DataFrame, texts: DataFrame, keys: Sequence[str], quote: str = "quote", text: str = "text", pad: int = 42) -> DataFrame:
    """Quotes that occur verbatim in the text with the same keys, with position and context."""
    joined = quotes.join(texts.select(*keys, text), list(keys)).withColumn("at", F.instr(F.col(text), F.col(quote)) - 1).filter("at >= 0")
    return joined.withColumn("context", tx.snippet(text, "at", F.length(quote), pad)).drop(text)


def find_quotes(quotes: DataFrame, texts: DataFrame, key: str, quote: str, text: str = "text", block_rows: int = 5000) -> DataFrame:
    """quote rows x texts that hold them.  The quotes are a stated set; a checked small one is broadcast, a larger one goes in blocks by hash."""
    if small(quotes, block_rows):
        return texts.join(F.broadcast(quotes), F.contains(F.col(text), F.col(quote)))
    blocks = -(-quotes.count() // block_rows)
    out = None
    for b in range(blocks):
        part = quotes.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        got = texts.join(F.broadcast(part), F.contains(F.col(text), F.col(quote)))
        out = got if out is None else out.unionByName(got)
    return out


def verify_anchors(events: DataFrame, texts: DataFrame, keys: Sequence[str], terms: str = "terms") -> DataFrame:
    """Events with the first of their terms, in list order, that occurs in the chapter's text or title; others drop."""
    joined = events.join(texts.select(*keys, "text", "title"), list(keys))
    hit = F.try_element_at(F.filter(terms, lambda t: F.contains(F.col("text"), t) | F.contains(F.col("title"), t)), F.lit(1))
    return joined.withColumn("anchor", hit).filter("anchor is not null").drop("text", "title")


def anchor_quotes(quotes: DataFrame, texts: DataFrame, key: str, id_col: str, char_class: str, ends: str, least: int = 4, share: float = 0.6, group: int = 100) -> DataFrame:
    """id, key, sentence, how: the sentence of the text with the same key that a quote belongs to.

    exact: the quote without punctuation occurs; the sentence of its last character, and a quote that comes again takes the
    next hit.  fuzzy: else the sentence with the longest common substring of max(least, share * length) characters or more, of equals the
    first.  Others give how = 'none', sentence null.  A text meets its quotes in groups of `group`.
    """
    q = quotes.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.coalesce(tx.keep_chars("quote", char_class), F.lit("")).alias("q"))
    q = q.withColumn("turn", F.row_number().over(_by("key", "q", order="id"))).withColumn("no", F.floor((F.row_number().over(_by("key", order="id")) - 1) / group))
    asked = q.groupBy("key", "no").agg(F.collect_list(F.struct("id", "q", "turn")).alias("asked"))
    nets = F.transform(tx.split_sentences("text", ends, keep=True), lambda s: tx.keep_chars(s, char_class))
    met = asked.join(texts.select(F.col(key).alias("key"), nets.alias("nets")), "key", "left").select("key", "asked", "nets")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, at, how = [], [], [], []
            for i, (some, net) in enumerate(zip(batch.column("asked"), batch.column("nets"))):
                sentences = Sentences([x or "" for x in net.as_py() or ()])
                for one in some.as_py():
                    found = sentences.exact(one["q"], one["turn"]) if one["q"] else None
                    kind = "exact"
                    if found is None and one["q"]:
                        found, kind = sentences.nearest(one["q"], max(least, int(len(one["q"]) * share))), "fuzzy"
                    row.append(i)
                    ids.append(one["id"])
                    at.append(found)
                    how.append("none" if found is None else kind)
            id_type = batch.schema.field("asked").type.value_type.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), batch.column("key").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(how, pa.string())], names=["id", "key", "sentence", "how"])

    kinds = {f.name: f.dataType.simpleString() for f in q.schema.fields}
    out = met.mapInArrow(run, f"id {kinds['id']}, key {kinds['key']}, sentence int, how string")
    return out.select(F.col("id").alias(id_col), F.col("key").alias(key), "sentence", "how")


def _by(*keys: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


def clue_keys(clues: DataFrame, text: str, names: Sequence[str], char_class: str) -> DataFrame:
    """clue, priority, term: the whole phrase (3 characters or more), names in it, its bigrams; the first place of each term."""
    net = tx.keep_chars(text, char_class)
    whole = F.when(F.length(net) >= 3, F.array(net)).otherwise(F.array().cast("array<string>"))
    known = F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: F.contains(F.col(text), n)) if names else F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(whole, known, tx.grams_of(net, 2)))
    out = clues.select("clue", F.posexplode(keys).alias("priority", "term"))
    return out.filter(F.length("term") >= 2)


def clue_ledger(clues: DataFrame, main: DataFrame, notes: DataFrame, later: DataFrame, text: str, names: Sequence[str], char_class: str, most: int = 50) -> DataFrame:
    """clue, planted, noted, fulfilled (first chapter by key priority), status: fulfilled, planted only, none.

    Only keys that occur in 1..most chapters of the main text count.
    """
    keys = clue_keys(clues, text, names, char_class)
    terms = keys.select("term").distinct()
    in_main = term_hits(main, terms).groupBy("term").agg(F.count_distinct("chapter").alias("df"), F.min("chapter").alias("at"))
    used = keys.join(in_main.filter(F.col("df") <= most), "term")
    first = used.groupBy("clue").agg(F.min_by("at", "priority").alias("planted"))

    def hit(where: DataFrame, name: str) -> DataFrame:
        at = term_hits(where, used.select("term").distinct()).groupBy("term").agg(F.min("chapter").alias("c"))
        return used.select("clue", "priority", "term").join(at, "term").groupBy("clue").agg(F.min_by("c", "priority").alias(name))

    out = clues.select("clue").join(first, "clue", "left").join(hit(notes, "noted"), "clue", "left").join(hit(later, "fulfilled"), "clue", "left")
    status = F.when(F.col("fulfilled").isNotNull(), "fulfilled").when(F.col("planted").isNotNull(), "planted only").otherwise("none")
    return out.withColumn("status", status)


def prophecy_ledger(prophecies: DataFrame, notes: DataFrame, later: DataFrame, future: Sequence[str]) -> DataFrame:
    """id, person, noted, fulfilled, n_later.  `person` is the first non-null of the columns song_person, title_person, author.

    noted: first chapter with a note that names the person (full name, else its last two characters) and has a future-telling word.
    """
    subject = F.coalesce("song_person", "title_person", "author")
    p = prophecies.select("id", subject.alias("person")).filter("person is not null and person <> ''")
    names = p.select("person").distinct().withColumn("term", F.explode(F.array_distinct(F.array("person", F.right("person", F.lit(2))))))
    names = names.withColumn("full", F.col("term") == F.col("person"))
    telling = notes.filter(F.col("text").rlike("|".join(map(re.escape, future))))
    noted = term_hits(telling, names).groupBy("person").agg(F.min("chapter").alias("noted"))
    got = term_hits(later, names)
    seen = got.groupBy("person").agg(F.coalesce(F.min(F.when(F.col("full"), F.col("chapter"))), F.min("chapter")).alias("fulfilled"), F.count_distinct(F.when(F.col("full"), F.col("chapter"))).alias("n_later"))
    return p.join(noted, "person", "left").join(seen, "person", "left").select("id", "person", "noted", "fulfilled", F.coalesce("n_later", F.lit(0)).alias("n_later"))


def assign_by_bigrams(events: DataFrame, rows: DataFrame, event: str, row: str, text: str = "text") -> DataFrame:
    """event, row, shared: the row with the most shared distinct bigrams (the first of equals); events without any drop."""
    grams = lambda df, k: df.select(k, F.explode(F.array_distinct(tx.grams_of(text, 2))).alias("g"))
    n = grams(events, event).join(grams(rows, row), "g").groupBy(event, row).agg(F.count("*").alias("shared"))
    return top_n(n, [event], [F.desc("shared"), F.col(row)], 1).drop("rank")


def apparatus(notes: DataFrame, editions: Sequence[str], text: str = "text", quote: str = r"[「“\"]([^」”\"]+)[」”\"]") -> DataFrame:
    """Collation notes with a number, the lemma (the first quoted form), the different quoted forms and the editions named."""
    forms = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(quote), F.lit(1)))
    named = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("|".join(map(re.escape, editions))), F.lit(0)))
    out = notes.withColumns({"number": F.regexp_extract(text, r"^\D{0,3}(\d+)", 1), "forms": forms, "editions": named})
    return out.withColumn("lemma", F.try_element_at("forms", F.lit(1))).filter((F.size("forms") > 0) | (F.size("editions") > 0))


def build_variant_map(texts: DataFrame, edges: DataFrame, curated: DataFrame, char_class: str, common: DataFrame, least: int = 2) -> DataFrame:
    """source, target, how: characters outside the common set that occur `least` times get the common character that most of their 1- and 2-hop
    variant edges lead to; curated pairs win; a pair with itself drops."""
    chars = texts.select(F.explode(F.split(tx.keep_chars("text", char_class), "")).alias("source")).filter("source <> ''").groupBy("source").agg(F.count("*").alias("n"))
    rare = chars.filter(F.col("n") >= least).join(common.select(F.col("char").alias("source")), "source", "left_anti")
    one = rare.join(edges.withColumnRenamed("a", "source"), "source").select("source", F.col("b").alias("target"))
    two = one.join(edges.select(F.col("a").alias("target"), F.col("b").alias("next")), "target").select("source", F.col("next").alias("target"))
    votes = one.unionByName(two).join(common.select(F.col("char").alias("target")), "target", "left_semi").filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("votes"))
    best = top_n(votes, ["source"], [F.desc("votes"), F.col("target")], 1).select("source", "target", F.lit("voted").alias("how"))
    fixed = curated.select("source", "target", F.lit("curated").alias("how")).filter("source <> target")
    return fixed.unionByName(best.join(fixed.select("source"), "source", "left_anti"))


def variant_coverage(texts: DataFrame, variants: DataFrame, char_class: str, common: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """How well a variant map (source, target) does: one row with the characters of the class, those that are common, those that are mapped and the share of both; and the
    residue: characters that are neither, and occur `least` times or more, with their counts.  Texts give one row for each distinct character of a task."""
    chars = texts.select(F.explode(F.split(tx.keep_chars("text", char_class), "")).alias("char")).filter("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    known = chars.join(F.broadcast(common.select("char").distinct().withColumn("__c", F.lit(True))), "char", "left").join(F.broadcast(variants.select(F.col("source").alias("char")).distinct().withColumn("__v", F.lit(True))), "char", "left")
    is_common, mapped = F.coalesce("__c", F.lit(False)), F.col("__c").isNull() & F.coalesce("__v", F.lit(False))
    total = F.coalesce(F.sum("n"), F.lit(0))
    share = known.agg(total.alias("chars"), F.coalesce(F.sum(F.when(is_common, F.col("n"))), F.lit(0)).alias("common"), F.coalesce(F.sum(F.when(mapped, F.col("n"))), F.lit(0)).alias("mapped"))
    out = share.withColumn("coverage", F.round((F.col("common") + F.col("mapped")) / F.nullif(F.col("chars"), F.lit(0)), 6))
    return out, known.filter(~is_common & ~mapped & (F.col("n") >= least)).select("char", "n")
