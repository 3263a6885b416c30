"""Mention, occurrence and annotation facts, and the aggregates over them.

Dictionaries are DataFrames; texts are searched for all their terms in one pass (operators.dictionary), of any size and with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexicon_count
from .dictionary import all_rows, find_terms
from .ordered import top_n


def small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def _hits(texts: DataFrame, terms: DataFrame, text: str, term: str, keep: Sequence[str] | None, outer: bool, options: dict) -> DataFrame:
    """texts x terms where the text holds the term, with `__offsets`; a term that stands in several rows of terms gives each of them.  With
    `outer` a text without terms comes once, with nulls."""
    rows = all_rows(terms, term, **options)  # so that a dictionary that has to be worked out is worked out once
    found = find_terms(texts, terms, text, term, keep, rows=rows, **options)
    kept = [c for c in found.columns if c != "hits"]
    one = found.select(*kept, (F.explode_outer if outer else F.explode)("hits").alias("__hit")).select(*kept, F.col("__hit.term").alias("__found"), F.col("__hit.at").alias("__offsets"))
    side = (terms if rows is None else F.broadcast(terms.sparkSession.createDataFrame(rows, terms.schema))).withColumnRenamed(term, "__term")
    columns = [F.col("__found").alias(c) if c == term else side[c] for c in terms.columns]
    return one.join(side, F.col("__found") == F.col("__term"), "left" if outer else "inner").select(*[one[c] for c in kept], *columns, "__offsets")


def term_hits(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", keep: Sequence[str] | None = None, **options) -> DataFrame:
    """texts (only the columns in `keep`, if given) x terms where the text holds the term, with `n`, the number of non-overlapping
    occurrences, and `at`, their offsets."""
    return _hits(texts, terms, text, term, keep, False, options).withColumn("n", F.size("__offsets").cast("long")).withColumnRenamed("__offsets", "at")


def holding(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", keep: Sequence[str] | None = None, **options) -> DataFrame:
    """texts (or `keep`) x terms where the text holds the term."""
    return _hits(texts, terms, text, term, keep, False, options).drop("__offsets")


def holding_or_none(texts: DataFrame, terms: DataFrame, text: str, term: str, **options) -> DataFrame:
    """holding(), and every text that holds no term once, with nulls for the term's columns."""
    return _hits(texts, terms, text, term, None, True, options).drop("__offsets")


def mentions(blocks: DataFrame, aliases: DataFrame, keys: Sequence[str], least: int = 2, **options) -> DataFrame:
    """keys, name, n: occurrences of all aliases of a name in a block.  Aliases are not exclusive: a name inside another counts for both."""
    used = aliases.filter(F.length("term") >= least)
    return term_hits(blocks, used, keep=keys, **options).groupBy(*keys, "name").agg(F.sum("n").cast("long").alias("n"))


def occurrences(chapters: DataFrame, terms: DataFrame, group: str, order: str, cap: int, **options) -> DataFrame:
    """term x chapter counts; of each term and group the first `cap` chapters."""
    hits = term_hits(chapters, terms, keep=[group, order], **options).select(group, order, "term", "n")
    return top_n(hits, ["term", group], [F.col(order)], cap).drop("rank")


def image_facts(texts: DataFrame, images: DataFrame, keys: Sequence[str], names: DataFrame | None = None, **options) -> DataFrame:
    """keys, term, category, n; with `names`, a one-character term does not count inside a name that holds it (floored at 0)."""
    raw = term_hits(texts, images, keep=keys, **options).select(*keys, "term", "category", "n")
    if names is None:
        return raw
    holders = holding(names.select(F.col("term").alias("name")), images.filter(F.length("term") == 1).select(F.col("term").alias("image")), "name", "image", **options)
    inside = term_hits(texts, holders.select(F.col("name").alias("term"), "image"), keep=keys, **options).groupBy(*keys, "image").agg(F.sum("n").alias("sub"))
    joined = raw.join(inside.withColumnRenamed("image", "term"), [*keys, "term"], "left")
    return joined.withColumn("n", F.greatest(F.col("n") - F.coalesce("sub", F.lit(0)), F.lit(0))).drop("sub").filter("n > 0")


def cooccur(facts: DataFrame, name: str, keys: Sequence[str], k: int, normalized: bool = False) -> DataFrame:
    """Weight of every other name in the chapters of an anchor; top k.

    The self-join of the original counts each fact of the other name once per fact of the anchor.  Here the anchor's
    facts are counted per chapter and multiplied, so no pair rows are made.  `normalized` counts each chapter once.
    """
    anchor = facts.filter(F.col("name") == name).groupBy(*keys).agg(F.count("*").alias("m"))
    others = facts.filter(F.col("name") != name).groupBy(*keys, "name").agg(F.sum("n").alias("n"))
    weight = F.sum(F.col("n") if normalized else F.col("n") * F.col("m"))
    return others.join(anchor, list(keys)).groupBy("name").agg(weight.cast("long").alias("w")).orderBy(F.desc("w"), "name").limit(k)


def pair_cooccurrence(items: DataFrame, group: Sequence[str], item: str, least: int = 2, k: int | None = None) -> DataFrame:
    """Unordered pairs of different items of a dictionary in the same group; pairs per group are bounded by the dictionary's size squared."""
    one = items.select(*group, item).distinct()
    pairs = one.select(*group, F.col(item).alias("a")).join(one.select(*group, F.col(item).alias("b")), list(group)).filter("a < b")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return out if k is None else out.orderBy(F.desc("n"), "a", "b").limit(k)


def people_in(texts: DataFrame, names: DataFrame, keys: Sequence[str], cap: int = 3, **options) -> DataFrame:
    """keys, names: canonical names in a text, longest first; a name contained in a longer one that is there too is dropped; the first `cap`."""
    hits = term_hits(texts, names, keep=keys, **options).select(*keys, "term", "name").distinct()
    longer = hits.select(*keys, F.col("term").alias("long"))
    contained = F.contains(F.col("long"), F.col("term")) & (F.length("long") > F.length("term"))
    kept = hits.alias("h").join(longer.alias("l"), [F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys] + [contained], "left_anti")
    first = kept.groupBy(*keys, "name").agg(F.max(F.length("term")).alias("size"))
    ranked = top_n(first, keys, [F.desc("size"), F.col("name")], cap)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))


def range_join(events: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows whose position, whole or not, lies in a range.  A checked small range table is broadcast; else positions and ranges meet in
    cells as wide as the ranges are on average, so that ranges are in about two cells each."""
    inside = F.col(at).between(F.col(lo), F.col(hi))
    if small(ranges, broadcast_rows):
        return events.join(F.broadcast(ranges), inside)
    width = max(1.0, float(ranges.agg(F.avg(F.col(hi) - F.col(lo))).first()[0] or 1))
    cell = lambda c: F.floor(c / F.lit(width))
    spread = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("__cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    return events.withColumn("__cell", cell(F.col(at))).join(spread, "__cell").filter(inside).drop("__cell")


def prune_edges(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Edges between two different known nodes."""
    ids = nodes.select(F.col(node).alias("__n"))
    out = edges.filter(F.col(a) != F.col(b)).join(ids, F.col(a) == F.col("__n"), "left_semi")
    return out.join(ids, F.col(b) == F.col("__n"), "left_semi")


def arc(facts: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return facts.filter(F.col("name") == name).groupBy(*keys).agg(F.sum("n").cast("long").alias("hits"))


def hot_list(facts: DataFrame, k: int) -> DataFrame:
    return facts.groupBy("name").agg(F.sum("n").cast("long").alias("total")).orderBy(F.desc("total"), "name").limit(k)


def mention_span(facts: DataFrame, chapter: str, group: Sequence[str] = ()) -> DataFrame:
    """First and last chapter, number of chapters, total.  Distinct chapters are summed up before they are counted."""
    each = facts.groupBy(*group, "name", chapter).agg(F.sum("n").alias("n"))
    return each.groupBy(*group, "name").agg(F.min(chapter).alias("first"), F.max(chapter).alias("last"), F.count("*").alias("chapters"), F.sum("n").cast("long").alias("total"))


def density_per(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def annotation_density(annotations: DataFrame, chapters: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Annotations of a chapter, and per main block; top k."""
    n = annotations.groupBy(*keys).agg(F.count("*").alias("n")).join(chapters.select(*keys, "n_main"), list(keys))
    return n.select(*keys, "n", density_per(F.col("n") * 1.0, F.col("n_main"), 3).alias("per_block")).orderBy(F.desc("n"), *keys).limit(k)


def edition_dist(annotations: DataFrame, editions: str = "editions") -> DataFrame:
    return annotations.select(F.explode(editions).alias("edition")).groupBy("edition").agg(F.count("*").alias("n"))


def edition_matrix(annotations: DataFrame, chapter: str, k: int, editions: str = "editions") -> DataFrame:
    """edition, chapter, n of the k busiest editions, with the edition's total."""
    cells = annotations.select(F.explode(editions).alias("edition"), chapter).groupBy("edition", chapter).agg(F.count("*").alias("n"))
    totals = cells.groupBy("edition").agg(F.sum("n").cast("long").alias("total")).orderBy(F.desc("total"), "edition").limit(k)
    return cells.join(F.broadcast(totals), "edition")


def edition_affinity(annotations: DataFrame, chapter: Sequence[str], kind: str, signature: Column, least: int = 4) -> DataFrame:
    """edition x edition counts of shared notes, diagonal included: notes with the same chapter, kind and signature are the same note.

    Pairs per note are bounded by the number of editions squared.
    """
    signed = annotations.withColumn("__s", signature).filter(F.length("__s") >= least)
    one = signed.select(*chapter, kind, "__s", F.explode("editions").alias("e")).distinct()
    key = [*chapter, kind, "__s"]
    pairs = one.withColumnRenamed("e", "a").join(one.withColumnRenamed("e", "b"), key)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def max_normalize(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Each axis divided by its maximum (0 counts as 1); the maxima are one row."""
    tops = df.agg(*[F.max(a).alias(f"__{a}") for a in axes])
    scaled = {a: F.col(a) / F.when(F.col(f"__{a}") == 0, 1).otherwise(F.col(f"__{a}")) for a in axes}
    return df.crossJoin(F.broadcast(tops)).withColumns(scaled).drop(*[f"__{a}" for a in axes])


def affect_curve(blocks: DataFrame, keys: Sequence[str], moods: dict[str, str]) -> DataFrame:
    """Blocks of each chapter with any term of a mood, and all blocks."""
    hits = [F.sum(F.when(F.col("text").rlike(p), 1).otherwise(0)).cast("long").alias(m) for m, p in moods.items()]
    return blocks.groupBy(*keys).agg(*hits, F.count("*").alias("blocks"))


def annotator_stats(annotations: DataFrame, chapter: str, span: int = 80) -> DataFrame:
    """Per edition: notes, characters, mean length, chapters covered, notes per `span` chapters."""
    one = annotations.select(F.explode("editions").alias("edition"), chapter, F.length("text").alias("len"))
    each = one.groupBy("edition", chapter).agg(F.count("*").alias("n"), F.sum("len").alias("chars"))
    total = each.groupBy("edition").agg(F.sum("n").cast("long").alias("n"), F.sum("chars").cast("long").alias("chars"), F.count("*").alias("covered"))
    return total.select("edition", "n", "chars", F.round(F.col("chars") / F.col("n"), 6).alias("mean_len"), "covered", F.round(F.col("n") * 1.0 / span, 6).alias("density"))


def annotator_types(annotations: DataFrame, kind: str) -> DataFrame:
    """edition, kind, n: histogram of note types."""
    return annotations.select(F.explode("editions").alias("edition"), kind).groupBy("edition", kind).agg(F.count("*").alias("n"))


def annotator_moods(annotations: DataFrame, moods: dict[str, Sequence[str]]) -> DataFrame:
    """edition and, per mood, its terms per 1000 characters of the edition's notes."""
    one = annotations.select(F.explode("editions").alias("edition"), F.length("text").alias("__n"), *[lexicon_count("text", ws).alias(m) for m, ws in moods.items()])
    rate = lambda m: F.round(F.sum(m) * 1000.0 / F.greatest(F.sum("__n"), F.lit(1)), 6).alias(m)
    return one.groupBy("edition").agg(*[rate(m) for m in moods])


def annotator_samples(annotations: DataFrame, keys: Sequence[str], moods: dict[str, Sequence[str]], longest: int = 3, per_mood: int = 2) -> DataFrame:
    """edition, why, rank, keys, text: the longest notes of each edition, and those with the most terms of each mood."""
    one = annotations.select(F.explode("editions").alias("edition"), *keys, "text")
    scores = {"longest": (F.length("text").cast("long"), longest)} | {m: (lexicon_count("text", ws), per_mood) for m, ws in moods.items()}
    out = None
    for why, (score, n) in scores.items():
        scored = one.withColumn("__s", score).filter("__s > 0")
        part = top_n(scored, ["edition"], [F.desc("__s"), *[F.col(k) for k in keys]], n).select("edition", F.lit(why).alias("why"), "rank", *keys, "text")
        out = part if out is None else out.unionByName(part)
    return out


def segment_summary(facts: DataFrame, segments: DataFrame, at: str, kind: str, chars: DataFrame, top: int = 3) -> DataFrame:
    """Per segment: facts, kinds, kinds per 10,000 characters, share of the `top` most frequent kinds."""
    inside = range_join(facts, segments, at, "lo", "hi").groupBy("segment", kind).agg(F.count("*").alias("n"))
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("n"), kind)))
    per = ranked.groupBy("segment").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("kinds"), F.sum(F.when(F.col("__r") <= top, F.col("n"))).alias("head"))
    size = range_join(chars, segments, at, "lo", "hi").groupBy("segment").agg(F.sum("chars").alias("chars"))
    return per.join(size, "segment").select("segment", "n", "kinds", F.round(F.col("kinds") * 10000.0 / F.col("chars"), 6).alias("kinds_per_10k"), F.round(F.col("head") / F.col("n"), 6).alias("concentration"))


def segment_shares(facts: DataFrame, segments: DataFrame, at: str, kind: str, category: str, top: int = 5) -> DataFrame:
    """segment, what, label, n, share: facts of each category, and the `top` most frequent kinds, with their share of the segment's facts."""
    inside = range_join(facts, segments, at, "lo", "hi").groupBy("segment", kind, category).agg(F.count("*").alias("n"))
    total = inside.groupBy("segment").agg(F.sum("n").alias("all"))
    by_category = inside.groupBy("segment", F.col(category).alias("label")).agg(F.sum("n").cast("long").alias("n"))
    by_kind = inside.groupBy("segment", F.col(kind).alias("label")).agg(F.sum("n").cast("long").alias("n"))
    first = top_n(by_kind, ["segment"], [F.desc("n"), F.col("label")], top).drop("rank")
    every = by_category.withColumn("what", F.lit("category")).unionByName(first.withColumn("what", F.lit("kind")))
    return every.join(total, "segment").select("segment", "what", "label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def period_means(df: DataFrame, periods: DataFrame, at: str, metrics: Sequence[str]) -> DataFrame:
    """label, n and the mean of each metric over the rows of each period (label, lo, hi)."""
    return range_join(df, periods, at, "lo", "hi").groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def cooccur_of(facts: DataFrame, anchors: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """anchor, name, w, rank: cooccur() of every name in `anchors` at once; anchors are a part of the dictionary, so rows per chapter are bounded by its size squared."""
    m = facts.join(anchors.select("name").distinct(), "name", "left_semi").groupBy(*keys, F.col("name").alias("anchor")).agg(F.count("*").alias("m"))
    n = facts.groupBy(*keys, "name").agg(F.sum("n").alias("n"))
    w = n.join(m, list(keys)).filter("name <> anchor").groupBy("anchor", "name").agg(F.sum(F.col("n") * F.col("m")).cast("long").alias("w"))
    return top_n(w, ["anchor"], [F.desc("w"), F.col("name")], k)


def stance_digest(claims: DataFrame, topic: str, agent: str, order: str, text: str = "text", width: int = 120) -> DataFrame:
    """topic, agent, other, said: for every agent of a topic the latest statement of each other one, cut at `width` characters.  Pairs are bounded by the agents of a topic."""
    last = claims.groupBy(topic, agent).agg(F.max_by(F.substring(text, 1, width), order).alias("said"))
    others = last.select(topic, F.col(agent).alias("other"), "said")
    return last.select(topic, agent).join(others, topic).filter(F.col(agent) != F.col("other"))


def taken_up(hits: DataFrame, name: str, source: str, order: str, first: str, second: str) -> DataFrame:
    """name, at, taken: what occurs in the first source, where first, and whether the second one takes it up."""
    each = hits.filter(F.col(source).isin(first, second)).groupBy(name).agg(F.min(F.when(F.col(source) == first, F.col(order))).alias("at"), F.max(F.col(source) == second).alias("taken"))
    return each.filter("at is not null")


def associations(persons: DataFrame, objects: DataFrame, label: str, text: str, cap: int = 10, **options) -> DataFrame:
    """name, n, objects: how many objects' text holds the person's name, and the first `cap` of them by label."""
    each = holding(objects.select(label, text), persons.select("name", "term"), text, "term", **options).select("name", label).distinct()
    first = top_n(each, ["name"], [F.col(label)], cap).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", label))), lambda x: x[label]).alias("objects"))
    return each.groupBy("name").agg(F.count("*").alias("n")).join(first, "name")


def head_tail_means(df: DataFrame, group: Sequence[str], chapter: str, metrics: Sequence[str], split: int, end: int) -> DataFrame:
    """Long form: metric, means of chapters up to `split` and of (split, end], and how many there are."""
    long_ = df.select(*group, chapter, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(*group, chapter, "x.metric", "x.v")
    head, tail = F.col(chapter) <= split, (F.col(chapter) > split) & (F.col(chapter) <= end)
    return long_.groupBy(*group, "metric").agg(F.round(F.avg(F.when(head, F.col("v"))), 6).alias("head"), F.round(F.avg(F.when(tail, F.col("v"))), 6).alias("tail"), F.count(F.when(head, 1)).alias("n_head"), F.count(F.when(tail, 1)).alias("n_tail"))


def quartiles(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """min, q1, median, q3, max by index round(f * (n - 1)), half up, and the upper median v[n // 2].

    Equal values are counted before anything is gathered; the positions come from running counts over distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(*group, value, (F.sum("c").over(upto) - F.col("c")).alias("lo"), F.sum("c").over(upto).alias("hi"), F.sum("c").over(Window.partitionBy(*group)).alias("n"))
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col(value)))
    index = lambda f: F.floor(F.lit(f) * (F.col("n") - 1) + 0.5)
    return placed.groupBy(*group).agg(at(F.lit(0)).alias("least"), at(index(0.25)).alias("q1"), at(index(0.5)).alias("median"), at(index(0.75)).alias("q3"), F.max(value).alias("most"), at(F.floor(F.col("n") / 2)).alias("upper_median"))
