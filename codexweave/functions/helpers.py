"""Small vectorised helpers for what Spark has no expression for.  Each works on Arrow batches and keeps no state."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Substrings:
    """All substrings of a pattern, as a suffix automaton; built, and run over a text, in linear time."""

    def __init__(self, pattern: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in pattern:
            new = self._state(self.size[last] + 1, {})
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][c]
                if self.size[to] == self.size[at] + 1:
                    self.link[new] = to
                else:
                    twin = self._state(self.size[at] + 1, dict(self.next[to]), self.link[to])
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def _state(self, size: int, next_: dict[str, int], link: int = 0) -> int:
        self.next.append(next_)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def longest_in(self, text: str) -> int:
        """Length of the longest substring of the pattern that the text holds."""
        at = size = best = 0
        for c in text:
            while at and c not in self.next[at]:
                at = self.link[at]
                size = self.size[at]
            if c in self.next[at]:
                at, size = self.next[at][c], size + 1
                best = max(best, size)
        return best


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring."""
    return Substrings(min(a, b, key=len)).longest_in(max(b, a, key=len))


class Sentences:
    """The sentences of a text, for many quotes."""

    def __init__(self, nets: list[str], size: int = 4):
        self.nets, self.all, self.gram = nets, "".join(nets), size
        self.ends = list(accumulate(map(len, nets)))
        self._holders: dict[str, list[int]] | None = None

    def exact(self, quote: str, turn: int) -> int | None:
        """The sentence of the last character of the turn-th occurrence (of the last one, if there are fewer)."""
        at, found = self.all.find(quote), -1
        while at >= 0 and turn > 0:
            found, turn = at, turn - 1
            at = self.all.find(quote, at + len(quote))
        return None if found < 0 else bisect_left(self.ends, found + len(quote))

    def holders(self) -> dict[str, list[int]]:
        """The sentences that hold each n-gram."""
        if self._holders is None:
            self._holders = {}
            for i, net in enumerate(self.nets):
                for g in {net[j : j + self.gram] for j in range(len(net) - self.gram + 1)}:
                    self._holders.setdefault(g, []).append(i)
        return self._holders

    def nearest(self, quote: str, need: int) -> int | None:
        """The sentence with the longest substring in common with the quote, of at least `need` characters; of equals the first.

        A common substring of that length holds one of every need - gram + 1 n-grams in a row.  So of each such row only the rarest n-gram is
        looked up, and very common ones are left alone unless nothing else would do.
        """
        if need < self.gram:
            among = range(len(self.nets))
        else:
            index = self.holders()
            rare = [len(index.get(quote[j : j + self.gram], ())) for j in range(len(quote) - self.gram + 1)]
            row = need - self.gram + 1
            picked = {min(range(j, j + row), key=rare.__getitem__) for j in range(len(rare) - row + 1)}
            among = sorted({i for j in picked for i in index.get(quote[j : j + self.gram], ())})
        pattern, best, found = Substrings(quote), need - 1, None
        for i in among:
            n = pattern.longest_in(self.nets[i])
            if n > best:
                best, found = n, i
        return found


_BRACES = re.compile(r"\{\{|\}\}")
_MARKS = re.compile(r"[\[\]{}|]")


def _argument(inner: str) -> str:
    """The longest unnamed argument of a template; bars inside brackets do not part arguments."""
    parts, depth, at = [], 0, 0
    for m in _MARKS.finditer(inner):
        if m[0] != "|":
            depth += 1 if m[0] in "[{" else -1
        elif not depth:
            parts.append(inner[at : m.start()])
            at = m.end()
    parts.append(inner[at:])
    return max((p.strip() for p in parts[1:] if "=" not in p), key=len, default="")


def _outermost(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and content of each template that is in no other.  One that does not close reaches to the end, and loses its last two characters."""
    depth = start = 0
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            if not depth:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                yield start, m.end(), text[start + 2 : m.start()]
    if depth:
        yield start, len(text), text[start + 2 : max(start + 2, len(text) - 2)]


def expand_templates(text: str | None, levels: int = 8) -> str | None:
    """{{name|a|b}} replaced by its longest unnamed argument: outermost templates first, then those that the arguments held, up to `levels` deep."""
    for _ in range(levels):
        if text is None or "{{" not in text:
            break
        out, at = [], 0
        for lo, hi, inner in _outermost(text):
            out += [text[at:lo], _argument(inner)]
            at = hi
        text = "".join([*out, text[at:]])
    return text


@F.pandas_udf(T.StringType())
def templates_out(text: pd.Series) -> pd.Series:
    return text.map(expand_templates, na_action="ignore")


def wikitext_to_text(col):
    """Wiki text without comments, references, font marks, templates, links (their labels stay), emphasis and headings marks; line breaks are new lines."""
    out = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</?font[^>]*>", ""), r"(?i)<br\s*/?\s*>", "\n")
    out = F.when(F.contains(out, F.lit("{{")), templates_out(out)).otherwise(out)
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://\S+ ([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"'{2,}", "")
    out = F.regexp_replace(out, r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")
    out = F.regexp_replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")
