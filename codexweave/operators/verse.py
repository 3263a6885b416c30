"""Verse detection, poem statistics and corrections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .dictionary import BLOCK_ROWS
from .facts import holding, image_facts, range_join, small, term_hits
from .ordered import top_n
from .store import checkpoint


@dataclass(frozen=True)
class Form:
    """What verse looks like.  The defaults are those of Chinese regular verse; lists of words are the caller's (`read_dictionary`)."""

    cuts: str = "，。！？；：\n"
    lengths: tuple[int, int] = (4, 7)
    uniform: float = 0.75
    most_xu: float = 0.13
    least_rhyme: float = 0.5
    least_lines: int = 4
    window: int = 160
    bad_run: int = 5
    function_chars: str = ""
    edge: str = r"(?!)"  # matches nothing
    anchor: str = r"(?!)"
    anchor_back: int = 240
    unit: str = "char"  # clause length in characters or in words


def clause_list(text: str, form: Form) -> list[tuple[int, int, int, float, str]]:
    """(start, end, length, function share, rhyme key) of each clause."""
    out = []
    function, drop = frozenset(form.function_chars), re.compile(r"[\W_]")
    for m in re.finditer(f"[^{re.escape(form.cuts)}]+", text):
        body = drop.sub("", m[0])
        if not body:
            continue
        size = len(body) if form.unit == "char" else len(m[0].split())
        xu = (sum(map(body.count, function)) if len(function) <= 16 else sum(map(function.__contains__, body))) / len(body)
        out.append((m.start(), m.end(), size, xu, body[-1] if form.unit == "char" else body[-2:]))
    return out


def verse_spans(text: str, form: Form) -> list[tuple[int, int, int, int, float]]:
    """(start, end, lines, main length, rhyme) of the longest verse windows, from left to right."""
    return [span for _, span in spans_of_all([text], form)]


def spans_of_all(texts: Sequence[str], form: Form) -> Iterator[tuple[int, tuple[int, int, int, int, float]]]:
    """Number of the text and span of verse_spans; texts are judged together, GROUP clauses or one text at a time."""
    lo, hi = form.lengths
    usual, long_enough = tuple(range(lo, hi + 1)), (form.least_lines, form.window)
    fits = (Rule(usual, long_enough, form.uniform, form.most_xu, form.least_rhyme), Rule(usual, long_enough, form.uniform, form.most_xu / 2, anchored=True))
    rules = Rules(rules=fits, usual=form.lengths, prose_xu=float("inf"), prose_run=form.bad_run, window=form.window)

    def settle(held: list[tuple[int, list[Clause]]]) -> Iterator[tuple[int, tuple[int, int, int, int, float]]]:
        clauses = [c for _, some in held for c in some]
        sizes = [len(some) for _, some in held]
        ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat([no for no, _ in held], sizes)

        def anchored(i: int) -> bool:
            at = clauses[i].start
            return re.search(form.anchor, texts[owner[i]][max(0, at - form.anchor_back) : at]) is not None

        def prose(i: int) -> bool:
            return re.search(form.edge, texts[owner[i]][clauses[i].start : clauses[i].end]) is not None

        best = _last_ends(clauses, ends, rules, anchored)
        done = 0
        for i in np.flatnonzero(best >= 0).tolist():
            if i < done:
                continue
            own = Window()
            for c in clauses[i : int(best[i]) + 1]:
                own.add(c)
            first, last = i, int(best[i])
            done = last + 1
            while first < last and prose(first):
                first += 1
            while last > first and prose(last):
                last -= 1
            if last - first + 1 >= form.least_lines:
                yield int(owner[i]), (clauses[first].start, clauses[last].end, last - first + 1, own.main, own.rhyme())

    held, n = [], 0
    for no, text in enumerate(texts):
        some = [Clause(start, end, "", "", size, xu, 0, key) for start, end, size, xu, key in clause_list(text, form)]
        if some:
            held.append((no, some))
            n += len(some)
        if n >= GROUP:
            yield from settle(held)
            held, n = [], 0
    if held:
        yield from settle(held)


def verse_by_form(chapters: DataFrame, keys: Sequence[str], form: Form = Form()) -> DataFrame:
    """keys, start, end, n_lines, main_len, rhyme: verse found by its form, chapter by chapter."""
    names = list(keys)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keyed = list(batch[names].itertuples(index=False))
            rows = [(*keyed[no], *span) for no, span in spans_of_all([t or "" for t in batch["text"]], form)]
            yield pd.DataFrame(rows, columns=[*names, "start", "end", "n_lines", "main_len", "rhyme"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chapters.select(*names).schema.fields)
    return chapters.select(*names, "text").mapInPandas(find, f"{kinds}, start long, end long, n_lines long, main_len long, rhyme double")


@dataclass(frozen=True)
class Rule:
    """A window is verse if its usual clause length, number of clauses and shares are these; `anchored` needs an anchor word before it."""

    lengths: tuple[int, ...]
    clauses: tuple[int, int]
    uniform: float
    most_xu: float
    least_rhyme: float = 0.0
    least_imagery: float = 0.0
    anchored: bool = False


# The rules of regular verse, for two or three clauses, for lines of five and seven and for lines of four and six.
REGULAR = (
    Rule((5, 7), (2, 3), 0.7, 0.08, anchored=True),
    Rule((5, 7), (4, 7), 0.75, 0.10, least_rhyme=0.5),
    Rule((5, 7), (4, 7), 0.75, 0.07, anchored=True),
    Rule((5, 7), (8, 160), 0.75, 0.11, least_rhyme=0.6),
    Rule((5, 7), (8, 160), 0.75, 0.13, least_rhyme=0.6, anchored=True),
    Rule((4, 6), (4, 160), 0.75, 0.05, least_rhyme=0.5, least_imagery=0.10, anchored=True),
)


@dataclass(frozen=True)
class Rules:
    """How verse is told from prose by rules per length.  Word lists and the table of rhyme classes are parameters.

    rhymes maps last characters to rhyme classes; a character that is not in it does not rhyme.  Without a table each ending is its own class.
    """

    rules: tuple[Rule, ...] = REGULAR
    cuts: str = "，。！？；,!?;\n"
    said: str = r"(?!)"  # a speaker before a clause
    script: str = r"[\u4e00-\u9fff]"  # characters that densities are taken over
    body: str = r"[，。！？；：、“”‘’（）《》,!?;:\s]"  # what is no part of a clause's body
    function_chars: str = ""
    imagery: str = ""
    rhymes: Mapping[str, str] | None = None
    anchor: str = r"(?!)"
    edge: str = r"(?!)"
    anchor_back: int = 240
    usual: tuple[int, int] = (4, 7)  # other clauses, and those of more than prose_xu, are prose
    prose_xu: float = 0.20
    prose_run: int = 5
    window: int = 160
    edge_xu: float = 0.22
    edge_lengths: tuple[int, int] = (2, 16)
    least_lines: int = 4
    unit: str = "char"  # clause length in characters or in words
    ending: int = 1  # characters that rhyme


@dataclass
class Clause:
    start: int
    end: int
    body: str
    speaker: str
    size: int
    xu: float
    images: int
    rhyme: str


def clauses_of(text: str, r: Rules) -> list[Clause]:
    out = []
    function, imagery, script, said = frozenset(r.function_chars), frozenset(r.imagery), re.compile(r.script), re.compile(r.said)
    drop = re.compile(r.body)
    for m in re.finditer(f"[^{re.escape(r.cuts)}]+", text):
        named = said.match(m[0])
        raw = m[0][named.end() :] if named else m[0]
        body = drop.sub("", raw)
        if body:
            signs = script.findall(body)
            xu = sum(map(function.__contains__, signs)) / len(signs) if signs else 1.0
            last = body[-r.ending :]
            lead = len(raw) - len(raw.lstrip())
            out.append(Clause(m.end() - len(raw) + lead, m.start() + len(m[0].rstrip()), body, named[0].strip("：: ") if named else "", len(raw.split()) if r.unit == "word" else len(body), xu, sum(map(imagery.__contains__, body)), last if r.rhymes is None else r.rhymes.get(last, "")))
    return out


class Window:
    """Counts of a window of clauses that grows at its end."""

    def __init__(self) -> None:
        self.n = self.chars = self.images = self.hits = self.main = self.evens = self.rhyming = 0
        self.xu = 0.0
        self.sizes: dict[int, int] = {}  # in order of the first clause of each
        self.classes: dict[str, int] = {}

    def add(self, c: Clause) -> None:
        if self.n % 2 and c.rhyme:
            k = self.classes[c.rhyme] = self.classes.get(c.rhyme, 0) + 1
            self.evens += 1
            if k > self.rhyming:
                self.rhyming = k
        self.n += 1
        size = c.size
        self.chars += size
        self.images += c.images
        self.xu += c.xu * size
        k = self.sizes[size] = self.sizes.get(size, 0) + 1
        if k > self.hits:
            self.hits, self.main = k, size
        elif k == self.hits and size != self.main:  # of equally frequent lengths the one met first
            self.main = next(s for s in self.sizes if s in (size, self.main))

    def rhyme(self) -> float:
        return self.rhyming / self.evens if self.evens >= 2 else 0.0

    def metrics(self) -> dict[str, float]:
        chars = max(1, self.chars)
        return {"n": self.n, "main_len": self.main, "uniform": self.hits / self.n, "xu": self.xu / chars, "imagery": self.images / chars, "rhyme": self.rhyme()}


def _last_ends(clauses: Sequence[Clause], ends: np.ndarray, r: Rules, anchored: Callable[[int], bool]) -> np.ndarray:
    """For each clause the last clause at which a window that begins with it is verse, or -1; `ends` are the ends of the clauses' texts.

    All windows grow together, one clause a step.  What a step needs to know of clause j and the window of the last k + 1 clauses is kept in arrays over j: `same`, how many are of its length,
    `head`, the first of these, and `rhymes`, how many of every other clause rhyme with it.  `anchored` is only asked where all else fits.
    """
    n = len(clauses)
    of = lambda values, kind: np.fromiter(values, kind, n)
    place = np.arange(n)
    size, images, density = of((c.size for c in clauses), np.int64), of((c.images for c in clauses), np.int64), of((c.xu for c in clauses), np.float64)
    classes: dict[str, int] = {}
    rhyme = of((classes.setdefault(c.rhyme, len(classes)) if c.rhyme else -1 for c in clauses), np.int64)
    odd = (size < r.usual[0]) | (size > r.usual[1]) | (density > r.prose_xu)
    run = place - np.maximum.accumulate(np.where(odd, -1, place))
    breaks = np.append(np.flatnonzero(run > r.prose_run), n)
    stop = np.minimum(np.minimum(breaks[np.searchsorted(breaks, np.minimum(place + r.prose_run, n))], ends - 1), place + r.window - 1)
    same, head, rhymes = np.ones(n, np.int64), place.copy(), np.ones(n, np.int64)
    best, asked = np.full(n, -1), np.full(n, -1, np.int8)
    start = place
    hits, main, first, chars, image, evens, rhyming = (np.zeros(n, np.int64) for _ in range(7))
    xu, weight = np.zeros(n), density * size
    for k in range(r.window):
        if not len(start):
            break
        if k:
            equal = size[k:] == size[:-k]
            same[k:] += equal
            np.copyto(head[k:], place[:-k], where=equal)
        j = start + k
        if k % 2:
            if k > 2:
                rhymes[k - 1 :] += rhyme[k - 1 :] == rhyme[: 1 - k]
            rhymed = rhyme[j] >= 0
            evens, rhyming = evens + rhymed, np.maximum(rhyming, np.where(rhymed, rhymes[j], 0))
        count, long_, since = same[j], size[j], head[j]
        more = count > hits
        other = more | ((count == hits) & (since < first))  # of equally frequent lengths the one met first
        hits, main, first = np.where(more, count, hits), np.where(other, long_, main), np.where(other, since, first)
        chars, image, xu = chars + long_, image + images[j], xu + weight[j]
        verse = np.zeros(len(start), bool)
        for x in sorted(r.rules, key=lambda x: x.anchored):
            if not x.clauses[0] <= k + 1 <= x.clauses[1]:
                continue
            size_fits = reduce(np.logical_or, [main == s for s in x.lengths])
            fits = size_fits & (hits >= x.uniform * (k + 1)) & (hits / (k + 1) >= x.uniform) & ~verse
            at = np.flatnonzero(fits)
            if len(at):
                every = np.maximum(chars[at], 1)
                share = np.where(evens[at] >= 2, rhyming[at] / np.maximum(evens[at], 1), 0.0)
                at = at[(xu[at] / every <= x.most_xu) & (image[at] / every >= x.least_imagery) & (share >= x.least_rhyme)]
            if x.anchored and len(at):
                for i in start[at][asked[start[at]] < 0].tolist():
                    asked[i] = anchored(i)
                at = at[asked[start[at]] == 1]
            verse[at] = True
        best[start[verse]] = j[verse]
        on = j < stop[start]
        if not on.all():
            start, hits, main, first, chars, image, evens, rhyming, xu = (a[on] for a in (start, hits, main, first, chars, image, evens, rhyming, xu))
    return best


def poems_of_all(texts: Sequence[str], r: Rules) -> Iterator[tuple[int, int, int, list[Clause], dict[str, float]]]:
    """Number of the text, start, end, clauses and metrics of the longest windows that are verse, from left to right, without prose at their edges.

    Texts are judged together, GROUP clauses or one text at a time.
    """
    edge, anchor = re.compile(r.edge), re.compile(r.anchor)
    prose = lambda c: c.xu > r.edge_xu or not r.edge_lengths[0] <= c.size <= r.edge_lengths[1] or edge.search(c.body)

    def settle(held: list[tuple[int, list[Clause]]]) -> Iterator[tuple[int, int, int, list[Clause], dict[str, float]]]:
        clauses = [c for _, some in held for c in some]
        sizes = [len(some) for _, some in held]
        ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat([no for no, _ in held], sizes)

        def anchored(i: int) -> bool:
            at = clauses[i].start
            return anchor.search(texts[owner[i]], max(0, at - r.anchor_back), at) is not None

        best = _last_ends(clauses, ends, r, anchored)
        done = 0
        for i in np.flatnonzero(best >= 0).tolist():
            if i < done:
                continue
            done = int(best[i]) + 1
            first, last = i, done - 1
            while first <= last and prose(clauses[first]):
                first += 1
            while last >= first and prose(clauses[last]):
                last -= 1
            kept = clauses[first : last + 1]
            if len(kept) >= r.least_lines:
                own = Window()
                for c in kept:
                    own.add(c)
                yield int(owner[i]), kept[0].start, kept[-1].end, kept, own.metrics()

    held, n = [], 0
    for no, text in enumerate(texts):
        some = clauses_of(text, r)
        if some:
            held.append((no, some))
            n += len(some)
        if n >= GROUP:
            yield from settle(held)
            held, n = [], 0
    if held:
        yield from settle(held)


def poems_of(text: str, r: Rules) -> Iterator[tuple[int, int, list[Clause], dict[str, float]]]:
    """Start, end, clauses and metrics of the verse of one text."""
    return (x[1:] for x in poems_of_all([text], r))


#: Clauses that are judged together.
GROUP = 1 << 14
POEM = "start long, end long, lines array<string>, speakers array<string>, n long, main_len long, uniform double, xu double, imagery double, rhyme double"


def verse_by_rules(chapters: DataFrame, keys: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """keys, start, end, lines, speakers and metrics (n, main_len, uniform, xu, imagery, rhyme) of the verse of each chapter, by rules per length."""
    names = list(keys)
    held = chapters.sparkSession.sparkContext.broadcast(rules)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            keyed = list(batch[names].itertuples(index=False))
            for no, start, end, kept, m in poems_of_all([t or "" for t in batch["text"]], held.value):
                rows.append((*keyed[no], start, end, [c.body for c in kept], [c.speaker for c in kept if c.speaker], *m.values()))
            yield pd.DataFrame(rows, columns=[*names, "start", "end", "lines", "speakers", "n", "main_len", "uniform", "xu", "imagery", "rhyme"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chapters.select(*names).schema.fields)
    return chapters.select(*names, "text").mapInPandas(find, f"{kinds}, {POEM}")


def _first_places(chapters: DataFrame, keys: Sequence[str], terms: DataFrame, term: str, order: Sequence[Column], dictionary: DataFrame) -> DataFrame:
    """keys, the columns of terms, text and __at, the place of the term: for each title the first hit by `order`, then keys, which name one chapter each.

    Hits go without their texts; only the chapters that are chosen, one for each title of the dictionary, are read again.
    """
    hit = term_hits(chapters, terms, term=term, keep=keys).select(*keys, *terms.columns, F.get("at", F.lit(0)).alias("__at"))
    best = top_n(hit, ["title"], [*order, *[F.col(k) for k in keys]], 1).drop("rank")
    side = F.broadcast(best) if small(dictionary, BLOCK_ROWS) else best
    text = chapters.select(*[F.col(k).alias(f"__{k}") for k in keys], "text")
    return text.join(side, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).select(*best.columns, "text")


def verse_by_seed(chapters: DataFrame, keys: Sequence[str], seeds: DataFrame, cuts: str, prefixes: Sequence[int] = (4, 3, 2)) -> DataFrame:
    """keys, title, start, end: a known opening (or, failing that, its first 4, 3, 2 characters), for its number of clauses, or to the paragraph's end if that is null."""
    tries = F.array_distinct(F.concat(F.array("opening"), F.array(*[F.substring("opening", 1, n) for n in prefixes])))
    spread = seeds.select("title", "lines", F.posexplode(tries).alias("try", "term")).filter(F.length("term") >= min(prefixes))
    best = _first_places(chapters, keys, spread, "term", [F.col("try")], seeds).withColumnRenamed("__at", "start")
    rest = F.substring("text", F.col("start") + 1, F.length("text"))
    clauses = F.regexp_extract_all(rest, F.lit(f"[^{re.escape(cuts)}]+[{re.escape(cuts)}]*"), F.lit(0))
    whole = F.regexp_extract(rest, r"(?s)^(.*?)(?:\n|$)", 1)
    size = F.when(F.col("lines").isNull(), F.length(whole)).otherwise(F.length(F.concat_ws("", F.slice(clauses, F.lit(1), F.col("lines")))))
    return best.select(*keys, "title", F.col("start").cast("long").alias("start"), (F.col("start") + size).cast("long").alias("end"))


def verse_by_title(chapters: DataFrame, keys: Sequence[str], titles: DataFrame, cuts: str, lines: int) -> DataFrame:
    """keys, title, start, end: the `lines` clauses that follow a title."""
    best = _first_places(chapters, keys, titles.select("title"), "title", [], titles).withColumn("at", F.col("__at") + F.length("title"))
    rest = F.substring("text", F.col("at") + 1, F.length("text"))
    lead = F.length(F.regexp_extract(rest, f"^[{re.escape(cuts)}\\s]*", 0))
    clauses = F.regexp_extract_all(rest, F.lit(f"[^{re.escape(cuts)}]+[{re.escape(cuts)}]*"), F.lit(0))
    size = F.length(F.concat_ws("", F.slice(clauses, 1, lines)))
    return best.select(*keys, "title", (F.col("at") + lead).cast("long").alias("start"), (F.col("at") + lead + size).cast("long").alias("end"))


def drop_overlaps(spans: DataFrame, keys: Sequence[str], routes: Sequence[str]) -> DataFrame:
    """Spans of all routes, without those that overlap one of a route named before theirs in the same chapter.  Spans are found once and written."""
    rank = F.array_position(F.array(*map(F.lit, routes)), F.col("route"))
    s = checkpoint(spans.withColumn("__r", rank))
    better = s.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("__r").alias("__q"))
    on = [s[k] == better[k] for k in keys] + [better["__q"] < s["__r"], better["__s"] < s["end"], s["start"] < better["__e"]]
    return s.join(better, on, "left_anti").drop("__r")


def poem_fixes(poems: DataFrame, overrides: DataFrame, deletes: Sequence[str], retitles: Mapping[str, str]) -> DataFrame:
    """poems with texts overridden by id, those whose text starts with a given prefix deleted, and titles set where the text holds a fragment."""
    fixed = poems.join(overrides.withColumnRenamed("text", "__t"), "id", "left").withColumn("text", F.coalesce("__t", "text")).drop("__t")
    for prefix in deletes:
        fixed = fixed.filter(~F.startswith("text", F.lit(prefix)))
    title = F.col("title")
    for fragment, new in retitles.items():
        title = F.when(F.contains("text", F.lit(fragment)), F.lit(new)).otherwise(title)
    return fixed.withColumn("title", title)


def poem_facts(poems: DataFrame, rules: Rules, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What depends on the poems' texts: metrics (id, n, main_len, uniform, xu, imagery, rhyme), lines (id, seq, line), images (id, term, category, n)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in batch[["id", "text"]].itertuples(index=False):
                own, bodies = Window(), []
                for c in clauses_of(text or "", rules):
                    own.add(c)
                    bodies.append(c.body)
                rows.append((key, bodies, *(own.metrics().values() if own.n else (0, 0, 0.0, 0.0, 0.0, 0.0))))
            yield pd.DataFrame(rows, columns=["id", "lines", "n", "main_len", "uniform", "xu", "imagery", "rhyme"])

    kind = poems.schema["id"].dataType.simpleString()
    every = poems.select("id", "text").mapInPandas(measure, f"id {kind}, lines array<string>, n long, main_len long, uniform double, xu double, imagery double, rhyme double")
    return every.drop("lines"), every.select("id", F.posexplode("lines").alias("seq", "line")), image_facts(poems, images, ["id"])


def fixed_poem_facts(before: DataFrame, after: DataFrame, facts: Sequence[DataFrame], rules: Rules, images: DataFrame) -> list[DataFrame]:
    """The facts of poem_facts brought up to date: computed anew only for poems whose text is another or new, dropped for those that are gone."""
    old = before.select("id", F.xxhash64("text").alias("__was"))
    state = after.select("id", F.xxhash64("text").alias("__is")).join(old, "id", "full")
    same = state.filter(F.col("__is") == F.col("__was")).select("id")
    changed = state.filter(F.col("__is").isNotNull() & ~F.col("__is").eqNullSafe(F.col("__was"))).select("id")
    fresh = poem_facts(after.join(changed, "id", "left_semi"), rules, images)
    return [f.join(same, "id", "left_semi").unionByName(n) for f, n in zip(facts, fresh)]


def guess_author(poems: DataFrame, pseudonyms: DataFrame, excluded: Sequence[str], back: int = 260) -> DataFrame:
    """poems with author: the pseudonym that stands last in the `back` characters of context before the poem, else the speaker; excluded genres stay empty."""
    ctx = poems.withColumn("__c", F.right("context", F.lit(back)))
    at = F.length(F.expr("substring_index(__c, term, -1)"))  # characters after the last occurrence
    hit = holding(ctx, pseudonyms, "__c").withColumn("__d", at).groupBy("id").agg(F.min_by("name", F.struct("__d", "term")).alias("__a"))
    joined = poems.join(hit, "id", "left")
    return joined.withColumn("author", F.when(F.col("genre").isin(list(excluded)), F.lit("")).otherwise(F.coalesce("author", "__a", "speaker", F.lit("")))).drop("__a")


def enrich_poems(poems: DataFrame, lines: DataFrame, style: DataFrame, width: int) -> DataFrame:
    """poems with their ordered lines (text cut at `width` characters where none are stored), a title (the first line if there is none) and their author's style ('' if unknown)."""
    stored = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    joined = poems.join(stored, "id", "left").join(style, "id", "left").withColumn("lines", F.coalesce("lines", cut))
    return joined.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.get("lines", F.lit(0)), F.lit(""))).withColumn("style", F.coalesce("style", F.lit("")))


def genre_chapters(poems: DataFrame, genres: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, n: poems of the given genres."""
    return poems.filter(F.col("genre").isin(list(genres))).groupBy(*keys).agg(F.count("*").alias("n"))


def rhyme_table(poems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rhyming poems: keys, title, genre, rhyme."""
    return poems.filter("rhyme > 0").select(*keys, "title", "genre", "rhyme")


def poem_density(poems: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, poems, lines, chars, poems per 10,000 characters, chapters without poems included."""
    n = poems.groupBy(*keys).agg(F.count("*").alias("poems"), F.sum("n_lines").cast("long").alias("lines"))
    out = chapters.select(*keys, F.length("text").cast("long").alias("chars")).join(n, list(keys), "left").na.fill(0, ["poems", "lines"])
    return out.withColumn("per_10k", F.round(F.col("poems") * 10000.0 / F.greatest("chars", F.lit(1)), 6))


def poem_ranges(poems: DataFrame, chapters: DataFrame, ranges: DataFrame, chapter: str = "chapter") -> DataFrame:
    """label, poems, lines, chapters, poems per 10,000 characters of each range (label, lo, hi) of chapters."""
    n = poems.groupBy(chapter).agg(F.count("*").alias("poems"), F.sum(F.greatest("n_lines", F.lit(1))).alias("lines"))
    size = chapters.groupBy(chapter).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("chapters"))
    every = range_join(size.join(n, chapter, "left").na.fill(0, ["poems", "lines"]), ranges, chapter, "lo", "hi")
    sums = every.groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("poems", "lines", "chapters", "chars")])
    return sums.select("label", "poems", "lines", "chapters", F.round(F.col("poems") * 10000.0 / F.greatest("chars", F.lit(1)), 6).alias("per_10k"))


def poet_profiles(poems: DataFrame, excluded: Sequence[str], densities: Mapping[str, str], char_class: str, chapter: str = "chapter", k: int | None = 16) -> DataFrame:
    """author, poems, lines, mean_line_len, a density per character of the class for each pattern, n_chapters, first, last of the k authors (None: all) with most poems, bracketed names last."""
    p = poems.filter(~F.col("genre").isin(list(excluded)) & (F.col("author") != ""))
    n = {d: F.regexp_count("text", F.lit(pattern)) for d, pattern in densities.items()}
    one = p.select("author", chapter, F.greatest("n_lines", F.lit(1)).alias("__l"), F.length("text").alias("__t"), F.length(tx.keep_chars("text", char_class)).alias("__z"), *[c.alias(f"__{d}") for d, c in n.items()])
    each = one.groupBy("author", chapter).agg(F.count("*").alias("poems"), *[F.sum(c).alias(c) for c in one.columns[2:]])
    sums = each.groupBy("author").agg(F.sum("poems").cast("long").alias("poems"), *[F.sum(c).cast("long").alias(c) for c in one.columns[2:]], F.count("*").alias("n_chapters"), F.min(chapter).alias("first"), F.max(chapter).alias("last"))
    ranked = sums.orderBy(F.startswith("author", F.lit("（")), F.desc("poems"), F.desc("__l"), "author")
    top = ranked if k is None else ranked.limit(k)
    rates = [F.round(F.col(f"__{d}") / F.greatest("__z", F.lit(1)), 6).alias(d) for d in densities]
    return top.select("author", "poems", F.col("__l").alias("lines"), F.round(F.col("__t") / F.col("__l"), 6).alias("mean_line_len"), *rates, "n_chapters", "first", "last")


def own_chars(poems: DataFrame, excluded: Sequence[str], char_class: str, stop: str, common: int = 400, least: int = 2, k: int = 10) -> DataFrame:
    """author, char, n, rank: of an author's `common` most frequent characters those that occur `least` times or more and with no other author; the first k."""
    p = poems.filter(~F.col("genre").isin(list(excluded)) & (F.col("author") != ""))
    chars = F.split(tx.keep_chars("text", char_class), "")
    each = p.select("author", F.explode(chars).alias("char")).filter((F.col("char") != "") & ~F.contains(F.lit(stop), F.col("char"))).groupBy("author", "char").agg(F.count("*").alias("n"))
    single = each.groupBy("char").agg(F.count("*").alias("authors")).filter("authors = 1").select("char")
    frequent = top_n(each, ["author"], [F.desc("n"), F.col("char")], common, "__r").filter(F.col("n") >= least)
    return top_n(frequent.join(single, "char", "left_semi").drop("__r"), ["author"], [F.desc("n"), F.col("char")], k)


def poet_stats(poems: DataFrame, images: DataFrame, excluded: Sequence[str], k: int | None = 16, top: int | None = 8) -> DataFrame:
    """author, poems, lines, mean_lines, mean_rhyme, images (the `top` most frequent ones): the k authors with most poems, bracketed names last.  None: all."""
    p = poems.filter(~F.col("genre").isin(list(excluded)) & (F.col("author") != ""))
    per = p.groupBy("author").agg(F.count("*").alias("poems"), F.sum(F.greatest("n_lines", F.lit(1))).cast("long").alias("lines"), F.avg("rhyme").alias("mean_rhyme"))
    used = images.join(p.select("id", "author"), "id").groupBy("author", "term").agg(F.sum("n").cast("long").alias("n"))
    kept = used if top is None else top_n(used, ["author"], [F.desc("n"), F.col("term")], top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), lambda x: x["term"])
    best = kept.groupBy("author").agg(F.concat_ws(",", listed).alias("images"))
    ranked = per.join(best, "author", "left").orderBy(F.startswith("author", F.lit("（")), F.desc("poems"), "author")
    shown = ranked if k is None else ranked.limit(k)
    return shown.select("author", "poems", "lines", F.round(F.col("lines") / F.col("poems"), 6).alias("mean_lines"), F.round("mean_rhyme", 6).alias("mean_rhyme"), F.coalesce("images", F.lit("")).alias("images"))


def salon_table(gatherings: DataFrame, poems: DataFrame, key: str = "chapter", k: int = 4) -> DataFrame:
    """gathering, poems, authors, genres: what was written at each gathering; the most common genres."""
    joined = gatherings.join(poems, key, "left")
    per = joined.groupBy("gathering").agg(F.count("id").alias("poems"), F.array_sort(F.collect_set(F.when(F.col("author") != "", F.col("author")))).alias("authors"))
    genres = top_n(joined.filter("genre is not null").groupBy("gathering", "genre").agg(F.count("*").alias("n")), ["gathering"], [F.desc("n"), F.col("genre")], k)
    listed = genres.groupBy("gathering").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "genre"))), lambda x: x["genre"]).alias("genres"))
    return per.join(listed, "gathering", "left")


def rhyme_tails(lines: DataFrame, k: int = 24) -> DataFrame:
    """Last characters of even-numbered lines (seq from 0: odd), most frequent first."""
    tails = lines.filter("seq % 2 = 1").select(F.right("line", F.lit(1)).alias("tail")).filter("tail <> ''")
    return tails.groupBy("tail").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tail").limit(k)


def confidence(rhyme: Column, xu: Column, yix: Column, genre: Column, bonus: Mapping[str, float]) -> Column:
    """0.5 rhyme + 0.3 max(0, 1 - xu / 0.28) + 0.2 min(1, yix / 0.30) + the genre's bonus, at most 1."""
    extra = F.coalesce(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv])[genre], F.lit(0.0)) if bonus else F.lit(0.0)
    return F.least(0.5 * rhyme + 0.3 * F.greatest(F.lit(0.0), 1 - xu / 0.28) + 0.2 * F.least(F.lit(1.0), yix / 0.30) + extra, F.lit(1.0))


def doubtful(poems: DataFrame, k: int = 14) -> DataFrame:
    """The k poems of least confidence; of equals the longer ones."""
    return poems.orderBy("confidence", F.desc("n_lines"), "id").limit(k)


def merge_strays(blocks: DataFrame, keys: Sequence[str], order: str, main: str, note: str, most: int = 4, ends: str = "。！？", tail: str | None = None, openers: str = "") -> DataFrame:
    """blocks of a document in order; a main block of at most `most` characters without a sentence end, between two notes, joins the note before it.

    With `tail` (the marks a note ends with) only a note that is cut off, and so ends with none of them, takes a stray; the notes after the stray are its
    remainder and join it too, until it ends with such a mark or the next one begins with one of `openers`.
    """
    names, kinds = list(keys), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keys, order, "kind", "text").schema.fields)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(order).to_dict("records")
        out: list[dict] = []
        open_ = False  # the last note has taken a stray and waits for its remainder
        for i, r in enumerate(rows):
            text = r["text"] or ""
            stray = r["kind"] == main and len(text) <= most and not any(c in ends for c in text)
            before = (out[-1]["text"] or "") if out and out[-1]["kind"] == note else None
            cut = before is not None and (tail is None or not before.endswith(tuple(tail)))
            if stray and cut and i + 1 < len(rows) and rows[i + 1]["kind"] == note:
                out[-1]["text"], open_ = before + text, tail is not None
            elif open_ and cut and r["kind"] == note and not text.startswith(tuple(openers)):
                out[-1]["text"] = before + text
            else:
                out.append(dict(r))
                open_ = False
        return pd.DataFrame(out, columns=[*names, order, "kind", "text"])

    return blocks.select(*names, order, "kind", "text").groupBy(*names).applyInPandas(merge, kinds)
