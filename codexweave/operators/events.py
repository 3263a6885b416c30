"""Scenes, acting persons and typed events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .facts import holding, term_hits
from .ordered import top_n


def split_scenes(blocks: DataFrame, keys: Sequence[str], order: str, marks: Sequence[str], soft_max: int = 1000, head: int = 6) -> DataFrame:
    """keys, scene, n_scenes, text: a scene starts at a block whose first `head` characters hold a mark, or once the scene has `soft_max` characters.

    The running size needs the blocks of a chapter in order; a chapter is one row while it is folded.
    """
    chapter = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("b"))
    marked = lambda t: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.substring(t, 1, head), m))

    def step(acc: Column, x: Column) -> Column:
        cut = (acc["size"] >= 0) & (marked(x["t"]) | (acc["size"] >= soft_max))
        size = F.when(cut | (acc["size"] < 0), F.length(x["t"])).otherwise(acc["size"] + F.length(x["t"]))
        starts = F.when(cut, F.concat(acc["starts"], F.array(acc["n"]))).otherwise(acc["starts"])
        return F.struct((acc["n"] + 1).alias("n"), size.alias("size"), starts.alias("starts"))

    first = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("size"), F.array(F.lit(0)).alias("starts"))
    cuts = chapter.withColumn("c", F.aggregate("b", first, step, lambda a: F.concat(a["starts"], F.array(a["n"]))))
    scenes = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat_ws("", F.transform(F.slice("b", F.get("c", i - 1) + 1, F.get("c", i) - F.get("c", i - 1)), lambda x: x["t"])))
    return cuts.select(*keys, (F.size("c") - 1).alias("n_scenes"), F.posexplode(scenes).alias("scene", "text"))


def fill_season(blocks: DataFrame, keys: Sequence[str], seasons: Mapping[str, Sequence[str]], names: Sequence[str]) -> DataFrame:
    """keys, raw: the season with the most terms in a chapter once names are taken out; the first of equals, null without any."""
    bare = F.col("text")
    for n in sorted(names, key=len, reverse=True):
        bare = F.replace(bare, F.lit(n), F.lit("〇"))
    counts = {s: F.sum(tx.lexicon_count(bare, ws)) for s, ws in seasons.items()}
    n = blocks.groupBy(*keys).agg(*[c.alias(f"__{s}") for s, c in counts.items()])
    top = F.greatest(*[F.col(f"__{s}") for s in seasons]) if len(seasons) > 1 else F.col(f"__{next(iter(seasons))}")
    raw = F.lit(None).cast("string")
    for s in reversed(list(seasons)):
        raw = F.when(F.col(f"__{s}") == top, F.lit(s)).otherwise(raw)
    return n.select(*keys, F.when(top > 0, raw).alias("raw"))


def events(scenes: DataFrame, keys: Sequence[str], aliases: DataFrame, types: DataFrame, action: str, quote_open: str, places: Sequence[str], ends: str, speech: str, within: int = 9) -> DataFrame:
    """keys, person, etype, acts, place, speech, n: what each acting person does in a scene.

    A person acts if an alias is followed by an action verb within `within` characters, or by an opening quote within 8.  The type has the
    largest sum of count * length^2 of its verbs over the sentences that name the person (equals: the lower type number);
    no verb, no event.  acts: the two heaviest verbs of that type.
    """
    hits = term_hits(scenes, aliases).drop("at")
    quoted = F.concat(F.lit(r"\Q"), F.col("term"), F.lit(r"\E"))
    acting = F.regexp_like("text", F.concat(quoted, F.lit(f"(?:.{{0,{within}}}(?:{action})|.{{0,7}}{quote_open})")))
    people = hits.withColumn("acts_here", acting).groupBy(*keys, "name").agg(F.max("acts_here").alias("acting"), F.sum("n").cast("long").alias("n"), F.collect_set("term").alias("terms"))
    who = people.filter("acting").join(scenes.select(*keys, "text"), list(keys))
    mine = F.filter(tx.split_sentences("text", ends, keep=True), lambda s: F.exists("terms", lambda t: F.contains(s, t)))
    place = F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, sorted(places, key=lambda p: (-len(p), p)))), lambda p: F.contains(F.col("text"), p)), F.lit(1)), F.lit(""))
    ctx = who.withColumn("__m", F.concat_ws("", mine)).select(*keys, F.col("name").alias("person"), "n", place.alias("place"), F.when(F.col("__m") == "", F.col("text")).otherwise(F.col("__m")).alias("ctx"))
    verbs = types.select("type_no", "etype", F.explode("verbs").alias("verb"))
    w = term_hits(ctx.drop("n"), verbs, "ctx", "verb", keep=[*keys, "person"]).withColumn("w", F.col("n") * F.length("verb") * F.length("verb"))
    scored = w.groupBy(*keys, "person", "type_no", "etype").agg(F.sum("w").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "verb"))).alias("v"))
    best = top_n(scored, [*keys, "person"], [F.desc("score"), F.col("type_no")], 1)
    acts = F.concat_ws("、", F.transform(F.slice("v", 1, 2), lambda x: x["verb"]))
    base = ctx.select(*keys, "person", "n", "place", F.col("ctx").rlike(speech).cast("long").alias("speech"))
    return best.select(*keys, "person", "etype", acts.alias("acts")).join(base, [*keys, "person"])


def event_facts(found: DataFrame, scenes: DataFrame, keys: Sequence[str], aliases: DataFrame, chapter: str, scene: str, scenes_in: str, src: Column, width: int = 30) -> DataFrame:
    """`found` (events) with t, quote and src: t is the chapter and the middle of the scene as a fraction of it; quote the text around the first alias of
    the person in the scene, of at most `width` characters."""
    named = scenes.withColumnRenamed(scenes_in, "__scenes")
    first = term_hits(named, aliases, keep=[*keys, "__scenes", "text"]).groupBy(*keys, F.col("name").alias("person")).agg(F.min(F.get("at", F.lit(0))).alias("__at"), F.first("text").alias("__text"), F.first("__scenes").alias("__n"))
    t = F.round(F.col(chapter) + (F.col(scene) + 0.5) / F.greatest(F.col("__n"), F.lit(1)), 4)
    return found.join(first, [*keys, "person"]).withColumns({"t": t, "quote": tx.centred_quote("__text", "__at", width), "src": src}).drop("__at", "__text", "__n")
