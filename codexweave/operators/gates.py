"""Rule gates over new documents, and what they need: plans, deaths, constraints, stored answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.corpus import upsert
from .facts import cooccur_of, holding, people_in
from .ordered import top_n

ISSUE = "gate STRING, detail STRING"


def forbidden(docs: DataFrame, keys: Sequence[str], markers: Sequence[str], denials: Sequence[str], back: int = 8) -> DataFrame:
    """keys, gate, detail: a marker with no denial word in the `back` characters before it; one issue per marker."""
    deny = "|".join(map(re.escape, denials))

    def hit(m: str):
        parts = F.transform(F.split("text", re.escape(m), -1), lambda p: F.right(p, F.lit(back)))
        before = F.slice(parts, F.lit(1), F.size(parts) - 1)  # what stands before each occurrence
        return F.exists(before, lambda p: ~p.rlike(deny)) if denials else F.size(before) > 0

    found = F.filter(F.array(*[F.when(F.contains(F.col("text"), F.lit(m)) & hit(m), F.lit(m)) for m in markers]), lambda x: x.isNotNull())
    return docs.select(*keys, F.lit("G1").alias("gate"), F.explode(found).alias("detail"))


def event_index(plan: DataFrame, events: DataFrame) -> DataFrame:
    """event, chapter: the first planned chapter whose title or brief holds one of the event's keywords."""
    rows = plan.select("chapter", F.concat_ws(" ", "title", "brief").alias("p"))
    return holding(rows, events, "p", "keyword").groupBy("event").agg(F.min("chapter").alias("at"))


def chronology(docs: DataFrame, plan: DataFrame, events: DataFrame, lead: int = 3) -> DataFrame:
    """A text must not hold the keywords of an event planned `lead` or more chapters later; one issue per event."""
    due = events.join(event_index(plan, events), "event")
    hit = holding(docs, due, term="keyword", keep=["chapter"]).filter(F.col("at") - F.col("chapter") >= lead)
    return hit.groupBy("chapter", "event").agg(F.min("keyword").alias("keyword")).select("chapter", F.lit("G2").alias("gate"), F.concat_ws(":", "event", "keyword").alias("detail"))


def deaths(docs: DataFrame, names: DataFrame, death: str) -> DataFrame:
    """name, died: the first chapter where a known name stands right before a death verb."""
    return holding(docs, names, term="name").filter(F.regexp_like("text", F.concat(F.lit(r"\Q"), "name", F.lit(r"\E(?:" + death + ")")))).groupBy("name").agg(F.min("chapter").alias("died"))


def deceased(docs: DataFrame, dead: DataFrame, actions: str, retrospect: Sequence[str], back: int = 14) -> DataFrame:
    """A name dead in an earlier chapter followed by an action, unless a retrospective word stands in the `back` characters before.  dead is counted first, so it should be a written table."""
    retro = "|".join(map(re.escape, retrospect))
    j = holding(docs, dead, term="name").filter(F.col("died") < F.col("chapter"))
    parts = F.split("text", F.concat(F.lit(r"\Q"), "name", F.lit(r"\E")), F.lit(-1))
    pairs = F.arrays_zip(F.slice("__p", F.lit(1), F.size("__p") - 1).alias("b"), F.slice("__p", F.lit(2), F.size("__p") - 1).alias("a"))
    bad = F.exists(pairs, lambda x: x["a"].rlike(f"^(?:{actions})") & ~F.right(x["b"], F.lit(back)).rlike(retro))
    return j.withColumn("__p", parts).filter(bad).select("chapter", F.lit("G3").alias("gate"), F.col("name").alias("detail"))


def taboo(docs: DataFrame, taboos: DataFrame) -> DataFrame:
    """A person and one of their taboo words in one text."""
    hit = holding(docs, taboos.filter(F.length("taboo") >= 2), term="person").filter(F.contains("text", "taboo"))
    return hit.select("chapter", F.lit("G4").alias("gate"), F.concat_ws(":", "person", "taboo").alias("detail"))


def grounding(docs: DataFrame, known: DataFrame, speaker: str, not_name: str, generic: Sequence[str], k: int = 6) -> DataFrame:
    """Speakers that are no known name or place, hold no function character and are not generic; the first k of a chapter, each once, as a warning."""
    cand = docs.select("chapter", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(speaker), F.lit(1)))).alias("detail"))
    cand = cand.filter((F.length("detail") >= 2) & ~F.col("detail").isin(list(generic)))
    if not_name:
        cand = cand.filter(~F.col("detail").rlike(f"[{not_name}]"))
    unknown = cand.join(known.select(F.col("name").alias("detail")), "detail", "left_anti")
    ranked = unknown.withColumn("rank", F.dense_rank().over(Window.partitionBy("chapter").orderBy("detail"))).filter(F.col("rank") <= k)
    return ranked.select("chapter", F.lit("G5").alias("gate"), "detail").dropDuplicates()


def body_checks(docs: DataFrame, char_class: str, band: tuple[int, int], markers: Sequence[str], dialogue: str, least: int, ending: str, last: int = 160, blank: str = r"\p{Z}\s") -> DataFrame:
    """Length band, stray markers, a heading mark (after characters of `blank`, if any), dialogue marks, the required ending."""
    n = F.length(tx.keep_chars("text", char_class))
    tests = {
        "short": n < band[0],
        "long": n > band[1],
        "marker": F.col("text").rlike("|".join(map(re.escape, markers))),
        "heading": F.col("text").rlike(f"^[{blank}]*#"),
        "dialogue": F.regexp_count("text", F.lit(dialogue)) < least,
        "ending": ~F.contains(F.right("text", F.lit(last)), F.lit(ending)),
    }
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    return docs.select("chapter", F.lit("body").alias("gate"), F.explode(issues).alias("detail"))


def recheck(docs: DataFrame, issues: Sequence[DataFrame], warnings: Sequence[str] = ("G5",)) -> DataFrame:
    """chapter, failed, issues (sorted): all gates together, one row for each text."""
    every = issues[0]
    for i in issues[1:]:
        every = every.unionByName(i)
    per = every.groupBy("chapter").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "gate", "detail"))).alias("issues"), F.max(~F.col("gate").isin(list(warnings))).alias("hard"))
    return docs.select("chapter").join(per, "chapter", "left").select("chapter", F.coalesce("hard", F.lit(False)).alias("failed"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def recheck_changed(docs: DataFrame, stored: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chapter, failed, issues, digest: `stored` (the same columns) brought up to date with docs (chapter, text).

    Only documents whose digest is not the stored one go through `run` (docs -> chapter, failed, issues); the others keep their rows, and rows of
    documents that are gone go.
    """
    now = docs.select("chapter", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    stale = now.join(stored.select("chapter", "digest"), ["chapter", "digest"], "left_anti")
    fresh = run(docs.join(stale.select("chapter"), "chapter", "left_semi")).join(stale, "chapter").select("chapter", "failed", "issues", "digest")
    return upsert(stored.join(docs.select("chapter"), "chapter", "left_semi").select("chapter", "failed", "issues", "digest"), fresh, ["chapter"])


def plan_sanity(plan: DataFrame, dead: DataFrame, once: DataFrame) -> DataFrame:
    """kind, name, n: dead persons in the plan after their death; one-off events in more than one row."""
    blob = plan.select("chapter", F.concat_ws(" ", "title", "brief").alias("p"))
    late = holding(blob, dead, "p", "name").filter(F.col("died") < F.col("chapter")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("dead").alias("kind"), "name", "n")
    twice = holding(blob, once, "p", "keyword").groupBy("event").agg(F.count_distinct("chapter").alias("n")).filter("n > 1").select(F.lit("repeated").alias("kind"), F.col("event").alias("name"), "n")
    return late.unionByName(twice)


def constraint_list(clues: DataFrame, fates: DataFrame, rules: Sequence[str]) -> DataFrame:
    """kind, text: constraints from clues, fates and fixed rules, without repeats."""
    fixed = clues.sparkSession.createDataFrame([("rule", r) for r in rules], "kind string, text string")
    out = clues.select(F.lit("clue").alias("kind"), F.col("clue").alias("text")).unionByName(fates.filter("fate <> ''").select(F.lit("fate").alias("kind"), F.concat_ws(": ", "name", "fate").alias("text")))
    return out.unionByName(fixed).dropDuplicates()


def open_threads(docs: DataFrame, order: str, label: str = r"(?m)^伏线[：:](.*)$", sep: str = "[；;、]", k: int = 20) -> DataFrame:
    """item, first: items of labelled lines by first appearance; the last k."""
    items = docs.select(order, F.explode(F.regexp_extract_all("text", F.lit(label), F.lit(1))).alias("line")).select(order, F.posexplode(F.split("line", sep)).alias("pos", "item"))
    first = items.withColumn("item", F.trim("item")).filter("item <> ''").groupBy("item").agg(F.min(F.struct(order, "pos")).alias("first"))
    return first.orderBy(F.desc("first"), "item").limit(k).select("item", F.col(f"first.{order}").alias("first"))


def parse_sections(answers: DataFrame, keys: Sequence[str], names: Sequence[str], text: str = "text") -> DataFrame:
    """keys, section, body: the parts after <<<name>>> marks; an answer without marks is one section, the first name."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.split(text, r"<<<\s*")
    marked = F.filter(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?s)^([^<>]+?)\s*>>>", 1).alias("section"), strip(F.regexp_replace(p, r"(?s)^[^<>]+?\s*>>>", "")).alias("body"))), lambda s: s["section"].isin(list(names)))
    whole = F.array(F.struct(F.lit(names[0]).alias("section"), strip(F.col(text)).alias("body")))
    return answers.select(*keys, F.explode(F.when(F.size(marked) > 0, marked).otherwise(whole)).alias("s")).select(*keys, "s.section", "s.body")


def parse_plan(answers: DataFrame, keys: Sequence[str], lo: int, hi: int, text: str = "text") -> DataFrame:
    """keys, chapter, title, brief of `no|title|brief` lines with a number in range; the first of each number."""
    line = r"(?m)^\s*(\d+)\s*\|\s*([^|\n]+)\|\s*([^|\n]+)$"
    rows = answers.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(line), F.lit(0))).alias("pos", "l"))
    parsed = rows.select(*keys, "pos", F.regexp_extract("l", line, 1).cast("int").alias("chapter"), F.trim(F.regexp_extract("l", line, 2)).alias("title"), F.trim(F.regexp_extract("l", line, 3)).alias("brief")).filter(F.col("chapter").between(lo, hi))
    return top_n(parsed, [*keys, "chapter"], [F.col("pos")], 1).drop("rank", "pos")


def parse_notes(answers: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, quote, note of `quote||note` lines."""
    line = r"(?m)^\s*([^|\n]+?)\s*\|\|\s*(.+?)\s*$"
    rows = answers.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(line), F.lit(0))).alias("l"))
    return rows.select(*keys, F.regexp_extract("l", line, 1).alias("quote"), F.regexp_extract("l", line, 2).alias("note"))


def parse_json(answers: DataFrame, keys: Sequence[str], schema: str, text: str = "text") -> DataFrame:
    """keys and the fields of the outermost JSON object in a fenced or free-text answer."""
    return answers.select(*keys, F.from_json(F.regexp_extract(text, r"(?s)([{].*[}])", 1), schema).alias("j")).filter("j is not null").select(*keys, "j.*")


def evidence_tables(topics: DataFrame, facts: DataFrame, names: DataFrame, keys: Sequence[str], affect: DataFrame, omens: DataFrame, editions: DataFrame, since: int = 70, persons: int = 2, tail: int = 12, near: int = 6, most_omens: int = 5, most_editions: int = 6) -> DataFrame:
    """topic, kind, name, label, n: of the persons named in a topic the end of the arc ('arc': label is the chapter) and who is with them ('cooccur'); for all
    topics, with null for the topic, moods of the chapters from `since` on ('affect'), the chapters with most omens and the largest editions."""
    who = people_in(topics, names, ["topic"], persons).select("topic", F.explode("names").alias("name"))
    arcs = top_n(facts.groupBy("name", "chapter").agg(F.sum("n").cast("long").alias("n")), ["name"], [F.desc("chapter")], tail)
    arc = who.join(arcs, "name").select("topic", F.lit("arc").alias("kind"), "name", F.col("chapter").cast("string").alias("label"), "n")
    together = cooccur_of(facts, who, keys, near).select(F.col("anchor").alias("name"), F.col("name").alias("label"), F.col("w").alias("n"))
    co = who.join(together, "name").select("topic", F.lit("cooccur").alias("kind"), "name", "label", "n")
    moods = [c for c in affect.columns if c not in ("chapter", "blocks")]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("long").alias("n")) for m in moods])).alias("x")
    none = F.lit(None).cast(topics.schema["topic"].dataType).alias("topic")
    felt = affect.filter(F.col("chapter") >= since).select("chapter", cells).select(none, F.lit("affect").alias("kind"), "x.name", F.col("chapter").cast("string").alias("label"), "x.n")
    ominous = omens.orderBy(F.desc("n"), "chapter").limit(most_omens).select(none, F.lit("omen").alias("kind"), F.lit("").alias("name"), F.col("chapter").cast("string").alias("label"), "n")
    largest = editions.orderBy(F.desc("n"), "edition").limit(most_editions).select(none, F.lit("edition").alias("kind"), F.lit("").alias("name"), F.col("edition").alias("label"), "n")
    return arc.unionByName(co).unionByName(felt).unionByName(ominous).unionByName(largest)


def evidence(topics: DataFrame, facts: DataFrame, names: DataFrame, tail: int = 12) -> DataFrame:
    """topic, name, chapters: of each person named in a topic (the first two), the last `tail` chapters of their arc as (chapter, hits)."""
    who = people_in(topics, names, ["topic"], 2).select("topic", F.explode("names").alias("name"))
    hits = facts.groupBy("name", "chapter").agg(F.sum("n").cast("long").alias("hits"))
    last = top_n(hits, ["name"], [F.desc("chapter")], tail)
    return who.join(last, "name").groupBy("topic", "name").agg(F.array_sort(F.collect_list(F.struct("chapter", "hits"))).alias("arc"))
