"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

The vocabulary is read from a tokenizer file (byte-level BPE with an end-of-word suffix).  For every word an
Aho-Corasick automaton of all tokens gives, in one pass, the longest token at each position.  The encoder walks
from left to right with these; a token may follow another only if the pair is compatible, that
is, if merging the concatenation of the two by rank gives exactly these two.  If no shorter token
fits either, it drops the last token and marks the position as a dead end, so
every position is left at most once and the time is linear.  A sequence whose neighbours are all compatible is
the one that merging by rank yields.

Decoding looks tokens up in one string by an offset table and joins them with single spaces,
which is what this tokenizer's decoder does (it has no decoder of its own).

Words repeat, so each task keeps a bounded table of encoded words (`CACHE_WORDS`); when it is full, words
not met lately leave it.

Defined results: null text counts as empty: no tokens, empty decoding.  Special strings in a text
are special tokens, as in the library.  Every code point is composed, split and folded as in the library, whose Unicode differs from
Python's: its own NFC is called, and tables below give the newer letters, numbers and lower cases.  Rows with equal ids are encoded separately.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, hold, numbered, place
from .words import slices_by_bytes

CACHE_WORDS = 200_000
#: Longer words are not kept in the table.
CACHE_CHARS = 64
# White space of the normaliser and the pattern of a word, as in the tokenizer file.
WHITE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{white}{letters}{numbers}]+"
# Letters and numbers of Unicode 16, which the library splits by, and lower cases of Unicode 17, which it
# folds by, as far as Python's own tables (Unicode 15.1) lack them.
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_LOWER = "1C89-1C89:1C8A A7CB-A7CB:0264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
SUFFIX = "</w>"
#: A word's last symbol is shifted by this much, so that a symbol with the suffix is one character.
_LAST = 0x1000


def _runs(spans: str) -> Iterator[tuple[int, int]]:
    for span in spans.split():
        lo, hi = span.split("-")
        yield int(lo, 16), int(hi, 16)


def character_class(initial: str, more: str, limit: int = 0x110000) -> str:
    """The body of a regular expression's class: code points whose category begins with `initial`, and those in `more`."""
    flag = np.fromiter((unicodedata.category(chr(c))[0] == initial for c in range(limit)), bool, limit)
    for lo, hi in _runs(more):
        flag[lo : hi + 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return "".join(f"\\U{lo:08x}-\\U{hi - 1:08x}" for lo, hi in edge.reshape(-1, 2).tolist())


def word_pattern(limit: int = 0x110000) -> re.Pattern:
    """A word, for texts of code points below `limit`."""
    return re.compile(WORD.format(white=WHITE, letters=character_class("L", NEW_LETTERS, limit), numbers=character_class("N", NEW_NUMBERS, limit)))


def new_lower() -> dict[int, int]:
    out = {}
    for span in NEW_LOWER.split():
        upper, to = span.split(":")
        for lo, hi in _runs(upper):
            out |= {c: int(to, 16) + c - lo for c in range(lo, hi + 1)}
    return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _folded(token: str) -> str:
    """The token with its suffix, if any, folded into the last character."""
    if token.endswith(SUFFIX):
        body = token[: -len(SUFFIX)]
        return body[:-1] + chr(ord(body[-1]) + _LAST)
    return token


class Encoder:
    def __init__(self, tokenizer_file: str):
        import ahocorasick
        from tokenizers.normalizers import NFC

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word, self.latin_word = word_pattern(), word_pattern(0x100)
        self.lower = new_lower()
        self.newer = re.compile("[" + "".join(map(chr, self.lower)) + "]")
        self.compose = NFC().normalize_str
        self.composing = re.compile(r"[^\x00-\u02ff]")
        self.beyond_latin = re.compile(r"[^\x00-\xff]")
        self.bytes = str.maketrans({chr(i): s for i, s in enumerate(byte_symbols())})
        strings = {i: t for t, i in (model["vocab"] | self.special).items()}
        # Offset table of all token strings, for decoding.
        blob, offsets = [], [0]
        for i in range(max(strings) + 1):
            blob.append(strings.get(i, ""))
            offsets.append(offsets[-1] + len(blob[-1]))
        self.blob, self.offsets = "".join(blob), offsets
        self.token = {_folded(t): i for t, i in model["vocab"].items()}
        self.size = {i: len(t) for t, i in self.token.items()}
        self.name = {i: t for t, i in self.token.items()}
        # Merges by rank: the parts of a token, and the rank at which two tokens join.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (pair.split(" ") if isinstance(pair, str) else pair)
            whole = model["vocab"][a + b]
            if whole in self.parts:
                raise ValueError(f"two merges make {a + b!r}; the pair table would be ambiguous")
            left, right = model["vocab"][a], model["vocab"][b]
            self.parts[whole], self.rank[whole], self.joins[left, right] = (left, right), r, r
        self.automaton = ahocorasick.Automaton()
        for t, i in self.token.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.known = _Known(self.encoded)

    def compatible(self, left: int, right: int) -> bool:
        """Does merging by rank leave `left` and `right` side by side?  Undo merges, latest first, on either side of the seam."""
        key = (left, right)
        bound = len(self.rank) + 1
        ok = True
        while True:
            joined = self.joins.get((left, right))
            if joined is not None and joined < bound:
                ok = False
                break
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                break
            # A join across the seam happens if its rank is below that of the merge that took its part away;
            # of equal ranks the one on the left goes first.
            if a > b:
                bound, left = a, self.parts[left][1]
            elif b > a:
                bound, right = b + 1, self.parts[right][0]
            else:
                bound, right = b + 1, self.parts[right][0]
        if len(self.fits) > 4 * CACHE_WORDS:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            name = self.name[token]
            self.shorter[token] = next((self.token[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.token), None)
        return self.shorter[token]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word as the pre-tokeniser gives it."""
        symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _LAST)
        n = len(symbols)
        longest: list[int | None] = [None] * n
        for end, (token, size) in self.automaton.iter(symbols):
            longest[end - size + 1] = token  # ends come in order, so the last one is the longest
        size_of, fits = self.size, self.fits
        out: list[int] = []
        open_ = bytearray(b"\x01" * (n + 1))
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + size_of[token]
                if open_[end]:
                    if last is None:
                        break
                    ok = fits.get((last, token))
                    if self.compatible(last, token) if ok is None else ok:
                        break
                token = self.next_shorter(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            elif last is None:
                raise ValueError("the vocabulary lacks a single symbol of this word")
            else:
                open_[at] = 0
                token = out.pop()
                at -= size_of[token]
                token = self.next_shorter(token)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.blob[self.offsets[i] : self.offsets[i + 1]] for i in ids])

    def encoded(self, word: str) -> tuple[str, str]:
        """Ids (decimal, joined by spaces) and decoding of a word."""
        ids = self.encode_word(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def words(self, text: str) -> list[str]:
        # Words never hold white space, so the normaliser's squeezing of it changes nothing here.
        # Below U+0300 nothing composes or is reordered; above, the library's classes and compositions are of an older Unicode than Python's.
        text = (self.compose(text) if self.composing.search(text) else text).replace("Σ", "σ").lower()
        if not self.beyond_latin.search(text):
            return self.latin_word.findall(text)
        return self.word.findall(text.translate(self.lower) if self.newer.search(text) else text)

    def both(self, text: str) -> tuple[str, str]:
        """Ids (decimal, joined by spaces) and decoding of a text."""
        got: list[tuple[str, str]] = []
        for i, section in enumerate(self.split_special.split(text)):
            if i % 2:
                token = self.special[section]
                got.append((str(token), self.decode([token])))
            elif section:
                got += [self.known[w] for w in self.words(section)]
        return " ".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.both(text)[0].split()]


class _Known(dict):
    """Encoded words; when it is full, only those met since it was last full stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        got = self.older.get(word) or self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: str = "text") -> DataFrame:
    """id, `keep`, n_tokens, ids (array of int) and the decoded text of every document, or with decoded="digest" its SHA-256."""
    return _run(docs, tokenizer_file, id_col, text_col, keep, False, decoded == "digest")


def encode_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """As encode(), with n_tokens and SHA-256 of the ids (decimal, joined by spaces) and of the decoded text instead."""
    return _run(docs, tokenizer_file, id_col, text_col, keep, True, True)


def _run(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, keep: tuple[str, ...], hash_ids: bool, hash_text: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", encoder.cache_clear)
        e = encoder(tokenizer_file)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            # Token ids take more room than digests, so fewer texts are held at once.
            for part in slices_by_bytes(batch, "__text", SLICE_BYTES if hash_ids else SLICE_BYTES // 16):
                counts, ids, decoded = [], [], []
                for text in part.column("__text"):
                    line, back = e.both(text.as_py() or "")
                    counts.append(line.count(" ") + 1 if line else 0)
                    ids.append(digest(line) if hash_ids else np.array(line.split(), np.int32))
                    decoded.append(digest(back) if hash_text else back)
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                id_column = pa.array(ids, pa.string()) if hash_ids else pa.ListArray.from_arrays(np.cumsum([0, *counts]).astype(np.int32), np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), id_column, pa.array(decoded, pa.string())], names=[*part.schema.names[:-1], "n_tokens", "a", "b"])

    names = list(dict.fromkeys([id_col, *keep]))
    cols: list[Column] = [place(docs, c).alias(f"__k{i}") for i, c in enumerate(names)]
    source = numbered(docs).select(*cols, place(docs, text_col).alias("__text"))
    schema = "".join(f"__k{i} {f.dataType.simpleString()}, " for i, f in enumerate(source.schema.fields[:-1]))
    out = source.mapInArrow(run, schema + f"n_tokens long, a {'string' if hash_ids else 'array<int>'}, b string")
    ids, text = "ids_sha256" if hash_ids else "ids", "decoded_sha256" if hash_text else "decoded"
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)], "n_tokens", F.col("a").alias(ids), F.col("b").alias(text))
