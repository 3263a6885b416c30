"""Concordances and fact ledgers: hits with context, amounts of money, wages, garments and colours."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.spans import with_spans
from .dictionary import BLOCK_ROWS, find_terms, with_longest
from .facts import holding_or_none, small, term_hits
from .ordered import top_n


def kwic(texts: DataFrame, terms: DataFrame, keys: Sequence[str], pad: int, names: DataFrame | None = None) -> DataFrame:
    """keys, term (and the terms' other columns), at, context; with `names`, the longest name in the window of `pad` characters around the hit."""
    found = find_terms(texts, terms, keep=keys, pad=pad)
    one = found.select(*keys, F.explode("hits").alias("h"))
    each = one.select(*keys, F.col("h.term").alias("term"), F.explode(F.arrays_zip("h.at", "h.context")).alias("x"))
    side = F.broadcast(terms) if small(terms, BLOCK_ROWS) else terms
    out = each.join(side, "term").select(*keys, "term", *[c for c in terms.columns if c != "term"], F.col("x.at").cast("long").alias("at"), F.col("x.context").alias("context"))
    return out if names is None else _with_person(out, names, "context")


def _with_person(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """rows with `person`: the name (of several the greatest) whose alias is the longest in the text."""
    known = names.groupBy(F.col("term").alias("__t")).agg(F.max("name").alias("person"))
    known = F.broadcast(known) if small(known, BLOCK_ROWS) else known
    return with_longest(rows, names, text, "term", "__t").join(known, "__t", "left").drop("__t")


def concordance_totals(hits: DataFrame, chapters: DataFrame, chapter: Sequence[str]) -> DataFrame:
    """chapter, n, per 1000 characters of all hits."""
    n = hits.groupBy(*chapter).agg(F.count("*").alias("n"))
    return n.join(chapters.select(*chapter, F.length("text").alias("chars")), list(chapter)).select(*chapter, "n", F.round(F.col("n") * 1000.0 / F.col("chars"), 6).alias("per_1000"))


def first_hits(blocks: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, name, term, at: one hit per block and object, by the first alias in priority order that occurs."""
    hits = term_hits(blocks, aliases, keep=keys)
    best = hits.withColumn("at", F.get("at", F.lit(0))).groupBy(*keys, "name").agg(F.min(F.struct("priority", "term", "at")).alias("b"))
    return best.select(*keys, "name", "b.term", F.col("b.at").cast("long").alias("at"))


def object_summary(hits: DataFrame, chapter: str, source: str) -> DataFrame:
    """name, first, last, n, and hits by source."""
    each = hits.groupBy("name", source).agg(F.count("*").alias("n"), F.min(chapter).alias("first"), F.max(chapter).alias("last"))
    return each.groupBy("name").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").cast("long").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("by_source"))


def owner_lanes(objects: DataFrame, people: DataFrame, last: DataFrame) -> DataFrame:
    """object, pos, name, fate, role, last: every owner in an object's chain of owners in order, with what is known of the person and the last mention."""
    chain = objects.select("object", F.posexplode(F.array_distinct(F.flatten(tx.parse_chain("owner")))).alias("pos", "name"))
    return chain.join(people.select("name", "fate", "role"), "name", "left").join(last.select("name", "last"), "name", "left").select("object", "pos", "name", "fate", "role", "last")


def amounts(blocks: DataFrame, keys: Sequence[str], pattern: str, value: Column, strong: Sequence[str], weak: Sequence[str], bad_follow: str, bounds: tuple[float, float], tags: Mapping[str, Sequence[str]], other: str, near: int = 14, wide: int = 26, names: DataFrame | None = None) -> DataFrame:
    """keys, at, raw, amount, tags: amounts with a strong word, or two weak ones, within `near` characters, within bounds.

    `value` computes the amount from the column raw.
    """
    hits = with_spans(blocks, "text", {"__s": pattern}).select(*keys, "text", F.explode("__s").alias("s"))
    at, end = F.col("s.start"), F.col("s.end")
    window = lambda pad: F.substring("text", F.greatest(at - pad, F.lit(0)) + 1, F.least(at, F.lit(pad)) + (end - at) + pad)
    rows = hits.select(*keys, at.cast("long").alias("at"), F.col("s.value").alias("raw"), window(near).alias("__near"), window(wide).alias("__wide"), F.substring("text", end + 1, F.lit(4)).alias("__after"))
    weak_n = F.size(F.filter(F.array(*[F.contains(F.col("__near"), F.lit(w)) for w in weak]), lambda x: x)) if weak else F.lit(0)
    context = (F.col("__near").rlike("|".join(map(re.escape, strong))) if strong else F.lit(False)) | (weak_n >= 2)
    kept = rows.filter(context & ~F.col("__after").rlike(f"^(?:{bad_follow})")).withColumn("amount", value).filter((F.col("amount") > bounds[0]) & (F.col("amount") < bounds[1]))
    out = kept.select(*keys, "at", "raw", "amount", tx.multi_tags("__wide", tags, other).alias("tags"), "__wide")
    return (out if names is None else _with_person(out, names, "__wide")).drop("__wide")


def amount_tiers(found: DataFrame, tiers: Sequence[tuple[str, float]]) -> DataFrame:
    """tier, n, total, most, sample: by the first tier whose upper bound is above the amount."""
    tier = F.lit(tiers[-1][0])
    for name, below in reversed(tiers[:-1]):
        tier = F.when(F.col("amount") < below, F.lit(name)).otherwise(tier)
    return found.withColumn("tier", tier).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 6).alias("total"), F.max("amount").alias("most"), F.max_by("raw", F.struct("amount", "raw")).alias("sample"))


def tag_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def near_anchor(blocks: DataFrame, keys: Sequence[str], anchors: str, pattern: str, reach: int = 60, per: int = 3, cell: int = 40) -> DataFrame:
    """keys, anchor, at, raw: matches within `reach` of an anchor word, the nearest `per` of each, one per cell of `cell` characters."""
    both = with_spans(blocks, "text", {"__a": anchors, "__m": pattern})
    pairs = both.filter(F.size("__a") > 0).select(*keys, F.explode("__a").alias("a"), "__m")
    close = pairs.select(*keys, F.col("a.start").alias("anchor"), F.explode(F.filter("__m", lambda m: F.abs(m["start"] - F.col("a.start")) <= reach)).alias("m"))
    rows = close.select(*keys, "anchor", F.col("m.start").alias("at"), F.col("m.value").alias("raw"))
    few = top_n(rows, [*keys, "anchor"], [F.abs(F.col("at") - F.col("anchor")), F.col("at")], per).drop("rank")
    return few.withColumn("__c", F.floor(F.col("at") / cell)).groupBy(*keys, "__c", "raw").agg(F.min(F.struct("anchor", "at")).alias("f")).select(*keys, "raw", F.col("f.anchor").alias("anchor"), F.col("f.at").alias("at"))


def decay_rows(blocks: DataFrame, keys: Sequence[str], words: Sequence[str], k: int, pad: int = 20) -> DataFrame:
    """The k blocks with the most words of decline, with the context of the first word (in list order) that occurs."""
    n = tx.lexicon_count("text", words)
    first = F.try_element_at(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w)), F.lit(1))
    rows = blocks.withColumn("n", n).filter("n > 0").orderBy(F.desc("n"), *keys).limit(k).withColumn("word", first)
    return rows.select(*keys, "n", "word", tx.snippet("text", F.instr(F.col("text"), F.col("word")) - 1, F.length("word"), pad).alias("context"))


def wear_scenes(blocks: DataFrame, keys: Sequence[str], verbs: Sequence[str], garments: Sequence[str], colours: Sequence[str], cuts: str, names: DataFrame, hand_over: str | None = None, stray: int = 10) -> DataFrame:
    """keys, clause, garment, colour, person, how: clauses with a wearing verb and a garment word.

    colour: the longest colour term of the clause, else one within `stray` characters before the garment in the line.  person: of the names in
    the clause the last before the verb ('subject'), else the first ('nearest'); with a hand-over word the first name after it ('receiver').
    """
    verb, garment = (f"({'|'.join(map(re.escape, sorted(ws, key=len, reverse=True)))})" for ws in (verbs, garments))
    colour = f"({'|'.join(map(re.escape, sorted(colours, key=len, reverse=True)))})"
    c = blocks.select(*keys, "text", F.posexplode(F.split("text", f"[{re.escape(cuts)}]")).alias("clause", "c")).filter(F.col("c").rlike(verb) & F.col("c").rlike(garment))
    g = F.regexp_extract("c", garment, 1)
    c = c.withColumns({"garment": g, "__v": F.instr(F.col("c"), F.regexp_extract("c", verb, 1)), "__in": F.regexp_extract("c", colour, 1)})
    before = F.right(F.expr("substring_index(text, garment, 1)"), F.lit(stray))
    c = c.withColumn("colour", F.coalesce(F.nullif(F.col("__in"), F.lit("")), F.nullif(F.regexp_extract(before, colour, 1), F.lit(""))))
    handed = F.instr(F.col("c"), F.lit(hand_over)) if hand_over else F.lit(0)
    j = holding_or_none(c.withColumn("__h", handed), names.select("name", "term"), "c", "term").withColumn("__n", F.instr(F.col("c"), F.col("term")))
    grouped = j.groupBy(*keys, "clause", "garment", "colour", "__v", "__h")
    receiver = F.min(F.when((F.col("__h") > 0) & (F.col("__n") > F.col("__h")), F.struct("__n", "name")))
    subject = F.max(F.when(F.col("__n") < F.col("__v"), F.struct("__n", "name")))
    nearest = F.min(F.when(F.col("__n").isNotNull(), F.struct(F.abs(F.col("__n") - F.col("__v")).alias("d"), "name")))
    got = grouped.agg(receiver.alias("r"), subject.alias("s"), nearest.alias("x"))
    person = F.coalesce("r.name", "s.name", "x.name")
    how = F.when(F.col("r").isNotNull(), "receiver").when(F.col("s").isNotNull(), "subject").when(F.col("x.name").isNotNull(), "nearest").otherwise("none")
    return got.select(*keys, "clause", "garment", "colour", person.alias("person"), how.alias("how"))


def colour_facts(blocks: DataFrame, keys: Sequence[str], verbs: Sequence[str], garments: Sequence[str], families: Mapping[str, Sequence[str]], cuts: str, pad: int = 10) -> DataFrame:
    """keys, at, term, family, how, context: the colours of clothes.

    how is 'scene' for colours in a clause with a wearing verb and a garment (context: the clause), and 'stray' for others with a garment within `pad` characters on
    either side (context: these characters).  Of overlapping colour terms the first and longest counts.  The places of colours, garments and clauses are each
    found once, in order, and go along together, so that a text takes linear time.
    """
    family = {t: f for f, ts in families.items() for t in ts}
    longest = lambda ts: re.compile("|".join(map(re.escape, sorted(set(ts), key=lambda t: (-len(t), t)))) or r"(?!)")
    colour, garment, verb, clause = longest(family), longest(garments), longest(verbs), re.compile(f"[^{re.escape(cuts)}]+")

    def find(text: str) -> Iterator[tuple[int, str, str, str]]:
        scenes = [m.span() for m in clause.finditer(text) if verb.search(m[0]) and garment.search(m[0])]
        scene = 0
        for m in colour.finditer(text):
            lo, hi = m.span()
            while scene < len(scenes) and scenes[scene][1] < hi:
                scene += 1
            if scene < len(scenes) and scenes[scene][0] <= lo:
                yield lo, m[0], "scene", text[slice(*scenes[scene])]
            elif garment.search(text, max(0, lo - pad), hi + pad):
                yield lo, m[0], "stray", text[max(0, lo - pad) : hi + pad]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rest = [], []
            for i, text in enumerate(batch.column("text")):
                for at, term, how, context in find(text.as_py() or ""):
                    row.append(i)
                    rest.append({"at": at, "term": term, "family": family[term], "how": how, "context": context})
            kept = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(len(keys))]
            more = pa.Table.from_pylist(rest, pa.schema([("at", pa.int64()), *[(c, pa.string()) for c in ("term", "family", "how", "context")]])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*kept, *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in more.columns]], names=[*batch.schema.names[:-1], *more.column_names])

    rows = blocks.select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, at long, term string, family string, how string, context string")


def garment_series(scenes: DataFrame, colours: DataFrame, chapters: DataFrame, keys: Sequence[str], window: int = 1000) -> DataFrame:
    """keys, scenes, colours, per `window` characters of the chapter, for every chapter with either."""
    keys = list(keys)
    n = scenes.groupBy(*keys).agg(F.count("*").alias("scenes")).join(colours.groupBy(*keys).agg(F.count("*").alias("colours")), keys, "full").na.fill(0, ["scenes", "colours"])
    size = chapters.select(*keys, F.length("text").alias("__n"))
    return n.join(size, keys).select(*keys, "scenes", "colours", F.round((F.col("scenes") + F.col("colours")) * float(window) / F.nullif(F.col("__n"), F.lit(0)), 4).alias("per"))


def garment_cast(scenes: DataFrame, colours: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """person, scenes, family, n, rank: for each person of a scene the k most frequent colour families of the blocks it is in."""
    keys = list(keys)
    who = scenes.filter("person is not null")
    totals = who.groupBy("person").agg(F.count("*").alias("scenes"))
    worn = who.select(*keys, "person").distinct().join(colours.filter("how = 'scene'"), keys).groupBy("person", "family").agg(F.count("*").alias("n"))
    return totals.join(top_n(worn, ["person"], [F.desc("n"), F.col("family")], k), "person", "left").select("person", "scenes", "family", "n", "rank")


def amount_series(found: DataFrame, chapter: str, anchors: Mapping[str, tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Amounts over the chapters (chapter, n, total), and over named stretches (anchor, n, total, median) given as first and last chapter."""
    series = found.groupBy(chapter).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 6).alias("total"))
    rows = [F.struct(F.lit(a).alias("anchor"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, (lo, hi) in anchors.items()]
    every = found.select("amount", F.col(chapter).alias("__c"), F.explode(F.array(*rows)).alias("a")).filter(F.col("__c").between(F.col("a.lo"), F.col("a.hi")))
    return series, every.groupBy(F.col("a.anchor").alias("anchor")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 6).alias("total"), F.median("amount").alias("median"))


def garment_persons(scenes: DataFrame, gifts: DataFrame) -> DataFrame:
    """person, scenes, garments, colours, gifts given."""
    worn = scenes.filter("person is not null").groupBy("person").agg(F.count("*").alias("scenes"), F.count_distinct("garment").alias("garments"), F.count_distinct("colour").alias("colours"))
    given = gifts.groupBy(F.col("giver").alias("person")).agg(F.count("*").alias("gifts"))
    return worn.join(given, "person", "full").select("person", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("scenes", "garments", "colours", "gifts")])
