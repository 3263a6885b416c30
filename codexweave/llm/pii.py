"""Personal data: base patterns, and identifiers found by bootstrapped contexts, in Spark functions only.

Base entities (e-mail, IP address, card number, telephone number) are the seeds.  The word, and the two
words, before a seed form lexical patterns of its kind.  Candidates are groups of digits with spaces, brackets, dots, slashes or dashes
between them (6 to 41 code points) and all other words of CANDIDATE_CHARS code points or more with a digit or an @; they have the
same two contexts.  Patterns and instances (values) make a bipartite graph whose edges are summed
over the corpus.  In each of `rounds` rounds a pattern's score is the mean score of the instances in
its context, weighted by occurrences, and a candidate's score for a kind is the mean score of the patterns it
stands in; seeds keep score 1 for their kind.  Patterns with `support` distinct seeds or more and a score of
`confidence` or more are accepted, and the candidates in their context are identifiers of that kind
(`ctx_email`, `ctx_ip`, `ctx_card`, `ctx_phone`).

Defined results: null text counts as empty.  Rows with equal id and text get equal results, one row each.
Spans are in code points, end exclusive.  A candidate that overlaps a base span is none.  Contexts are read from the CONTEXT_CHARS code points
before an entity: of a longer word only its end counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import render, with_spans
from .common import checkpoint, measured, pick, salted_join, sha256

# The base patterns.  Repeats are possessive and runs are entered at their start (or where the match
# before ended), which changes no match and keeps the time linear.
WORD = r"[^\x20\x09-\x0D]"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": rf"(?:\G|(?<!{WORD}))(?:\(?[+0-9][0-9()./\x20-]{{4,38}}[0-9](?![\p{{L}}0-9@])|[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD}*+)",
}
KINDS = ("email", "ip", "card", "phone")
#: Code points before an entity that its context is taken from.
CONTEXT_CHARS = 64
#: Code points of a candidate, at least.
CANDIDATE_CHARS = 6

BASE = "array<struct<kind_no:int,start:int,end:int,kind:string,value:string,left:string>>"


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""
    every = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(every, F.lit(0), lambda a, x: a + x) % 10 == 0


def _keep(kind: str):
    only = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    size = lambda s: F.length(only(s))
    part = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(False))
    return {
        "email": lambda s: F.lit(True),
        "ip": small,
        "card": lambda s: F.when(size(s).between(16, 19), luhn(only(s))).otherwise(False),
        "phone": lambda s: size(s).between(8, 15),
    }[kind]


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), base entities by kind, then start, and the candidates."""
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    spans = with_spans(rows, "text", PATTERNS, CONTEXT_CHARS)
    of_kind = lambda no, kind: F.transform(F.filter(kind, _keep(kind)), lambda s: F.struct(F.lit(no).alias("kind_no"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), s["left"].alias("left")))
    base = F.array_sort(F.concat(*[of_kind(no, kind) for no, kind in enumerate(KINDS)]))
    out = spans.select("id", F.xxhash64("text").alias("key"), base.cast(BASE).alias("base"), F.filter("other", lambda s: F.length(s["value"]) >= CANDIDATE_CHARS).alias("other"))
    outside = F.filter("other", lambda o: ~F.exists("base", lambda s: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return out.withColumn("other", outside)


def contexts(left: Column) -> Column:
    """The last word, and the last two words, before an entity, lower-cased; none if there is no word."""
    words = F.filter(F.split(F.lower(left), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one, two = F.element_at(words, -1), F.concat_ws(" ", F.slice(words, -2, 2))
    return F.when(F.size(words) >= 2, F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two))).when(F.size(words) == 1, F.array(F.concat(F.lit("1 "), one))).otherwise(F.array().cast("array<string>"))


def _mentions(rows: DataFrame) -> DataFrame:
    """One row for each entity: context, kind ('' for candidates), hash of the value."""
    base = rows.select(F.explode("base").alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.col("s.left").alias("left"))
    other = rows.select(F.explode("other").alias("s")).select(F.lit("").alias("kind"), F.col("s.value").alias("value"), F.col("s.left").alias("left"))
    every = base.unionByName(other).select("kind", F.xxhash64("value").alias("value"), F.explode(contexts(F.col("left"))).alias("context"))
    return every.groupBy("context", "kind", "value").agg(F.count("*").alias("n"))


def learn(rows: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """context, kind, score of the accepted patterns."""
    edges = checkpoint(_mentions(rows))
    seeds = edges.filter("kind <> ''")
    # Only contexts with enough distinct seeds of a kind can be accepted, so only these are nodes.
    patterns = seeds.groupBy("context", "kind").agg(F.count("*").alias("seeds"), F.sum("n").alias("hits")).filter(F.col("seeds") >= support)
    totals = edges.groupBy("context").agg(F.sum("n").alias("all"))
    patterns = checkpoint(patterns.join(totals, "context"))
    nodes = patterns.select("context").distinct()
    unseen, seen = measured(edges.filter("kind = ''").select("context", "value", "n").join(nodes, "context", "left_semi"), n=F.count(F.lit(1)))
    by = {c: checkpoint(unseen.groupBy(c).agg(F.count("*").alias("n"))) for c in ("context", "value")}
    scores = patterns.select("context", "kind", (F.col("hits") / F.col("all")).alias("score"))
    for _ in range(rounds):
        scored = salted_join(unseen, scores, ["context"], seen["n"], counts=by["context"], salt=["value"])
        instance = scored.groupBy("value", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("belief"))
        believed = salted_join(unseen, instance, ["value"], seen["n"], counts=by["value"], salt=["context"])
        credit = believed.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("credit"))
        joined = patterns.join(credit, ["context", "kind"], "left")
        scores = checkpoint(joined.select("context", "kind", ((F.col("hits") + F.coalesce("credit", F.lit(0.0))) / F.col("all")).alias("score")))
    return scores.filter(F.col("score") >= confidence)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """id, key, base and spans (arrays with kind, start, end), one row for each document."""
    rows, seen = measured(found(docs, id_col, text_col), n=F.sum(F.size("other")))
    accepted = checkpoint(learn(rows, rounds, support, confidence))
    other = rows.select("id", "key", F.explode("other").alias("s")).select("id", "key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode(contexts(F.col("s.left"))).alias("context"))
    hit = salted_join(other, accepted, ["context"], 2 * seen["n"], salt=["id", "start"]).groupBy("id", "key", "start", "end").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, len(KINDS) + i)]), F.col("kind"))
    per_text = hit.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct(number.alias("kind_no"), "start", "end", F.concat(F.lit("ctx_"), "kind").alias("kind")))).alias("more"))
    left, right = rows.select("id", "key", "base").alias("l"), per_text.alias("r")
    joined = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.key") == F.col("r.key")), "left")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select(F.col("l.id").alias("id"), F.col("l.key").alias("key"), plain(F.col("base")).alias("base"), F.concat(plain(F.col("base")), F.coalesce(plain(F.col("more")), none)).alias("spans"))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count_of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(F.col("id").alias(id_col), *map(count_of, KINDS), sha256(render(F.col("base"))).alias("base_sha256"), render(F.col("spans")).alias("spans"))
