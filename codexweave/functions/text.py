"""Column functions over text: cleaning, numerals, titles, sentences, densities, snippets, rules.

Script classes, delimiters and word lists are parameters; the defaults are those of a Chinese corpus.  All functions
are built-in expressions.  A null text gives null unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script classes and delimiters.
HAN = r"一-鿿"
LETTERS = r"\p{L}"
CJK_PUNCTUATION = "，。！？；：、…—·《》〈〉（）「」『』“”‘’?!,.;:"
SENTENCE_ENDS = "。！？；!?;"
# Numerals.
DIGITS = {"零": 0, "○": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERALS = "零一二三四五六七八九"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_chars(text: Column | str, char_class: str = HAN, punctuation: str = "") -> Column:
    """Only the characters of the class and of the punctuation."""
    return F.regexp_replace(_col(text), f"[^{char_class}{re.escape(punctuation)}]", "")


def drop_chars(text: Column | str, char_class: str) -> Column:
    return F.regexp_replace(_col(text), f"[{char_class}]", "")


def normalize_variants(text: Column | str, chars: Mapping[str, str], phrases: Sequence[tuple[str, str]] = ()) -> Column:
    """Phrase replacements in order, then a one-to-one character map.  Idempotent if no target is a source."""
    out = _col(text)
    for old, new in phrases:
        out = F.replace(out, F.lit(old), F.lit(new))
    pairs = [(a, b) for a, b in chars.items() if len(a) == len(b) == 1 and a != b]
    return F.translate(out, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else out


def parse_numeral(text: Column | str) -> Column:
    """Value of a Chinese numeral (units, or positional digits); a pair of digits before a unit is a range and gives its
    mean.  Null if a character is neither digit nor unit, or the text is empty."""
    chars = F.filter(F.split(_col(text), ""), lambda c: c != "")
    digit = F.create_map(*[F.lit(x) for k, v in DIGITS.items() for x in (k, float(v))])
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))])
    zero = F.lit(0.0)
    positional = F.forall(chars, lambda c: digit[c].isNotNull())

    def plain(acc: Column, c: Column) -> Column:
        return acc * 10 + digit[c]

    def step(acc: Column, c: Column) -> Column:
        d, u = digit[c], unit[c]
        ranged = (acc["n"] > 1) & ~acc["zero"]
        before = F.when(acc["n"] == 0, F.lit(1.0)).when(ranged, (acc["last"] + acc["previous"]) / 2).otherwise(acc["last"])
        return F.struct(
            F.when(u.isNotNull(), acc["total"] + before * u).otherwise(acc["total"]).alias("total"),
            F.when(u.isNotNull(), zero).otherwise(acc["last"]).alias("previous"),
            F.when(u.isNotNull(), zero).otherwise(d).alias("last"),
            F.when(u.isNotNull(), F.lit(0)).when(d == 0, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            F.when(u.isNotNull(), F.lit(False)).otherwise(acc["zero"] | (d == 0)).alias("zero"),
        )

    start = F.struct(zero.alias("total"), zero.alias("previous"), zero.alias("last"), F.lit(0).alias("n"), F.lit(False).alias("zero"))
    mixed = F.aggregate(chars, start, step, lambda a: a["total"] + a["last"])
    known = F.forall(chars, lambda c: digit[c].isNotNull() | unit[c].isNotNull())
    return F.when((F.size(chars) > 0) & known, F.when(positional, F.aggregate(chars, zero, plain)).otherwise(mixed))


def format_numeral(n: Column | str) -> Column:
    """Chinese numeral of 0..9999, without a leading 一 before 十."""
    n = _col(n).cast("int")
    d = lambda k: F.floor(n / k).cast("int") % 10
    ch = lambda v: F.substring(F.lit(NUMERALS), v + 1, F.lit(1))
    part = lambda k, name: F.when(d(k) > 0, F.concat(ch(d(k)), F.lit(name))).otherwise(F.lit("零"))
    raw = F.concat(part(1000, "千"), part(100, "百"), part(10, "十"), F.when(d(1) > 0, ch(d(1))).otherwise(F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "零+", "零"), "^零|零$", ""), "^一十", "十")
    return F.when(n == 0, F.lit("零")).otherwise(tidy)


def extract_title(text: Column | str, number: Column | str, heading: str = rf"(?m)^第([{''.join(DIGITS)}十百千]+)回[ 　]*(.*)$", parse=parse_numeral) -> Column:
    """Heading text if the heading's numeral is `number`, else ''."""
    text = _col(text)
    same = parse(F.regexp_extract(text, heading, 1)) == _col(number).cast("double")
    return F.when(same, F.trim(F.regexp_extract(text, heading, 2))).otherwise(F.lit(""))


def fix_title(title: Column | str, least: int = 6, invalid: str = r"[\|【】\[\]]") -> Column:
    """White space squeezed; '' if the title is too short or holds template residue."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(title), F.lit("")), r"[\s　]+", " "))
    return F.when((F.length(t) < least) | t.rlike(invalid), F.lit("")).otherwise(t)


def strip_noise_lines(text: Column | str, noise: str = r"^\s*[-—]?\s*\d+\s*[-—]?\s*$", least: int = 3) -> Column:
    """Without page numbers and other lines that match `noise`, and lines shorter than `least`."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.trim(x))
    return F.concat_ws("\n", F.filter(lines, lambda x: (F.length(x) >= least) & ~x.rlike(noise)))


def strip_body(text: Column | str, least: int = 40) -> Column:
    """From the first line of `least` characters on; the whole text if there is none."""
    text = _col(text)
    lines = F.split(text, "\n")
    long_ = F.transform(lines, lambda x, i: F.when(F.length(x) >= least, i))
    first = F.array_min(F.filter(long_, lambda x: x.isNotNull()))
    return F.when(first.isNull(), text).otherwise(F.concat_ws("\n", F.slice(lines, first + 1, F.size(lines))))


def decode_markers(marker: Column | str, editions: Mapping[str, str], kinds: Mapping[str, str], colour: Column | str | None = None, inks: Mapping[str, str] | None = None) -> Column:
    """struct(editions, kind, ink) of a marker string: edition, kind, then further editions."""
    marker = _col(marker)
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    chars = F.concat(F.substring(marker, 1, 1), F.substring(marker, F.lit(3), F.length(marker)))
    names = F.transform(F.filter(F.split(chars, ""), lambda c: c != ""), lambda c: table(editions)[c])
    ink = table(inks)[_col(colour)] if inks and colour is not None else F.lit(None).cast("string")
    return F.struct(F.array_distinct(F.filter(names, lambda n: n.isNotNull())).alias("editions"), table(kinds)[F.substring(marker, 2, 1)].alias("kind"), ink.alias("ink"))


def harvest_annotations(text: Column | str, editions: Sequence[str], kinds: Sequence[str], default_edition: str, open_: str = "【", close: str = "】") -> Column:
    """Array of struct(editions, kind, text) of the bracketed notes: a head of edition and kind names up to a colon, then the note."""
    o, c = re.escape(open_), re.escape(close)
    notes = F.regexp_extract_all(_col(text), F.lit(f"{o}([^{c}]*){c}"), F.lit(1))
    head = lambda n: F.regexp_extract(n, r"^([^：:]{1,12})[：:]", 1)

    def parse(n: Column) -> Column:
        found = F.filter(F.array(*map(F.lit, editions)), lambda e: F.contains(head(n), e))
        kind = F.try_element_at(F.filter(F.array(*map(F.lit, kinds)), lambda k: F.contains(head(n), k)), F.lit(1))
        known = (F.size(found) > 0) | kind.isNotNull()
        body = F.when(known, F.regexp_replace(n, r"^[^：:]{1,12}[：:]", "")).otherwise(n)
        return F.struct(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default_edition))).alias("editions"), kind.alias("kind"), F.trim(body).alias("text"))

    return F.transform(notes, parse)


def split_sentences(text: Column | str, ends: str = SENTENCE_ENDS, closers: str = "”’」』）", keep: bool = False) -> Column:
    """Sentences, blank ones dropped; with `keep`, each with its end marks and closing quotes."""
    e = re.escape(ends)
    if keep:
        parts = F.regexp_extract_all(_col(text), F.lit(f"[^{e}]+[{e}]*[{re.escape(closers)}]*"), F.lit(0))
    else:
        parts = F.split(_col(text), f"[{e}]")
    return F.filter(parts, lambda s: F.trim(s) != "")


def split_clauses(text: Column | str, cuts: str = "，。！？；：、\n", said: str = r"^(.{1,4})(?:笑道|说道|道)：", function_chars: str = "", rhyme: Mapping[str, str] | None = None, char_class: str = HAN) -> Column:
    """Array of struct(speaker, body, length, xu, rhyme): clauses without punctuation, function-character share, rhyme key of the last character
    (by the table, else the character itself)."""
    table = F.create_map(*[F.lit(x) for kv in rhyme.items() for x in kv]) if rhyme else None

    def clause(c: Column) -> Column:
        body = keep_chars(F.regexp_replace(c, said, ""), char_class)
        last = F.right(body, F.lit(1))
        key = F.coalesce(table[last], last) if table is not None else last
        return F.struct(F.regexp_extract(c, said, 1).alias("speaker"), body.alias("body"), F.length(body).alias("length"), class_density(body, function_chars, 0.0).alias("xu"), key.alias("rhyme"))

    lead = F.regexp_replace(_col(text), rf"({said[1:] if said.startswith('^') else said})", "$1")
    parts = F.split(lead, f"[{re.escape(cuts)}]")
    return F.filter(F.transform(parts, clause), lambda s: s["length"] > 0)


def count_term(text: Column | str, term: Column | str) -> Column:
    """Non-overlapping occurrences; `term` is a column or a literal string."""
    text, term = _col(text), term if isinstance(term, Column) else F.lit(term)
    n = F.length(term)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def grams_of(text: Column | str, n: int) -> Column:
    """All n-grams of a text, in order; by shifted lists of characters, so that the time is linear in the text."""
    chars = F.filter(F.split(_col(text), ""), lambda c: c != "")
    size = F.size(chars) - (n - 1)
    shifted = F.arrays_zip(*[F.slice(chars, F.lit(k + 1), F.greatest(size, F.lit(0))).alias(f"c{k}") for k in range(n)])
    return F.transform(shifted, lambda x: F.concat(*[x[f"c{k}"] for k in range(n)]))


def lexicon_count(text: Column | str, terms: Iterable[str]) -> Column:
    total = F.lit(0).cast("long")
    for t in dict.fromkeys(terms):
        total = total + count_term(text, t)
    return total


def density(text: Column | str, terms: Iterable[str], per: int = 1000) -> Column:
    n = F.length(_col(text))
    return F.when(n > 0, lexicon_count(text, terms) * float(per) / n).otherwise(F.lit(0.0))


def class_density(text: Column | str, chars: str, empty: float) -> Column:
    """Share of characters in a set; `empty` for an empty text."""
    text = _col(text)
    inside = F.length(text) - F.length(F.translate(text, chars, "")) if chars else F.lit(0)
    return F.when(F.length(text) > 0, inside / F.length(text)).otherwise(F.lit(empty))


def snippet(text: Column | str, at: Column | str, size: Column | int, pad: int = 26, marks: tuple[str, str] = ("〔", "〕")) -> Column:
    """`pad` characters on both sides of a hit (0-based position), the hit in brackets."""
    text, at = _col(text), _col(at)
    size = size if isinstance(size, Column) else F.lit(size)
    lo = F.greatest(at - pad, F.lit(0))
    return F.concat(F.substring(text, lo + 1, at - lo), F.lit(marks[0]), F.substring(text, at + 1, size), F.lit(marks[1]), F.substring(text, at + size + 1, F.lit(pad)))


def centred_quote(text: Column | str, at: Column | str, width: int = 30) -> Column:
    """At most `width` characters around a position, with ellipses where text is cut off."""
    text, at = _col(text), _col(at)
    lo = F.greatest(at - width // 2, F.lit(0))
    body = F.substring(text, lo + 1, F.lit(width))
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(lo + width < F.length(text), F.lit("…")).otherwise(F.lit("")))


def tail(text: Column | str, n: int) -> Column:
    return F.right(_col(text), F.lit(n))


def truncate_at_sentence(text: Column | str, limit: int, ends: str = SENTENCE_ENDS) -> Column:
    """Cut to `limit`, back to the last sentence end if that is beyond half the limit."""
    text = _col(text)
    cut = F.substring(text, 1, limit)
    last = F.length(F.regexp_extract(cut, f"(?s)^(.*[{re.escape(ends)}])", 1))
    return F.when(F.length(text) <= limit, text).when(last > limit / 2, F.substring(cut, F.lit(1), last)).otherwise(cut)


def parse_chain(text: Column | str, arrow: str = "→", alternatives: str = r"[／/]", note: str = r"[（(][^）)]*[）)]") -> Column:
    """Owner chain "A→B／C（note）": array of arrays of names; the giver is the first, the holder in the last element."""
    bare = F.regexp_replace(_col(text), note, "")
    return F.transform(F.split(bare, re.escape(arrow)), lambda s: F.filter(F.transform(F.split(s, alternatives), lambda x: F.trim(x)), lambda x: x != ""))


def chapter_range(text: Column | str) -> Column:
    """First to last integer of a text, inclusive; the first alone if they are reversed; empty array if there is none."""
    n = F.transform(F.regexp_extract_all(_col(text), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    first, last = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(-1))
    return F.when(F.size(n) == 0, F.array().cast("array<int>")).when(last >= first, F.sequence(first, last)).otherwise(F.array(first))


def classify(text: Column | str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (label, pattern) that matches."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(_col(text).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def multi_tags(window: Column | str, tags: Mapping[str, Sequence[str]], other: str) -> Column:
    """All tags any of whose terms occurs, else [other]."""
    hits = F.array(*[F.when(_col(window).rlike("|".join(map(re.escape, terms))), F.lit(tag)) for tag, terms in tags.items()])
    found = F.filter(hits, lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescape(text: Column | str) -> Column:
    """Character references resolved in one pass: decimal and hexadecimal numbers and the names of HTML 4; unknown names and numbers that are no character stay."""
    text = _col(text)
    names = F.create_map(*[F.lit(x) for name, code in [*name2codepoint.items(), ("apos", 39)] for x in (name, chr(code))])

    def resolve(ref: Column) -> Column:
        body = F.substring(ref, F.lit(2), F.length(ref) - 2)
        hexadecimal = F.lower(body).startswith("#x")
        after = lambda n: F.substring(body, F.lit(n), F.length(body))
        code = F.when(hexadecimal, F.conv(after(3), 16, 10).cast("long")).when(body.startswith("#"), after(2).cast("long"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.try_element_at(names, body), ref)

    found, pieces = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.split(text, ENTITY, -1)
    head = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.concat(p, resolve(m)))
    return F.when(F.contains(text, F.lit("&")), F.concat_ws("", head, F.element_at(pieces, -1))).otherwise(text)


def html_to_text(html: Column | str) -> Column:
    """Text of a page: styles, scripts, comments and reference marks dropped, block ends as line breaks, entities resolved, white space squeezed."""
    out = _col(html)
    for pattern in (r"(?is)<(style|script)\b[^>]*>.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?is)<sup\b[^>]*reference[^>]*>.*?</sup\s*>", r"(?is)<span\b[^>]*tooltip[^>]*>.*?</span\s*>"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|section|article|nav|footer|ul|ol)\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    out = F.translate(unescape(out), "\u00a0\u200b", " ")
    out = F.regexp_replace(out, r"[ \t\u3000]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{2,}", "\n"))
