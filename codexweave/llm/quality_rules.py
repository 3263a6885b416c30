"""Quality rules as a short-circuit cascade.

The statistics of the base rules (words, word characters, symbols, repeated lines, words inside repeated 8-word
windows) are computed for every text, vectorised over a slice of texts.  A text that fails
the base rules is out; the others go through the cascade: each rule looks only at the texts
that all rules before it have kept.  The order is by rejections per second, both
estimated on a bounded sample (`sample_rows` rows, chosen by hash of the id).  The verdict is the conjunction of
all rules and so does not depend on the order; only the work and `failed_rule` (the first
rule that rejects) do.

Defined results: null text: no words, base_failed.  Rows with equal ids are judged separately.  An empty table gives an empty
result; without a sample the rules keep the order in which they are listed.
"""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pick
from .words import mix, separator_table, slices_by_bytes, split_words, text_buffer, window_hash, window_ok

_TABLE = separator_table()
# What counts as a symbol; the repeat window.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
_LETTER = re.compile(r"[^\W\d_]")
_BULLETS = ("-", "*", "•", "·", "‣")


class Stats(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_lines: np.ndarray
    n_repeat_words: np.ndarray


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(h: np.ndarray, doc: np.ndarray, first: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Per text, the words inside windows of k words that occur twice or more in it."""
    windows = window_hash(h, k)
    keys = windows ^ mix(doc[: len(windows)].astype(np.uint64) + np.uint64(1))
    keys, at = keys[ok], np.flatnonzero(ok)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    return _per_text(np.cumsum(edge[:-1]) > 0, first)


def statistics(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> Stats:
    words = split_words(data, offsets, _TABLE)
    inside = (~_TABLE)[data] & ((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        seen: set[str] = set()
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\v\f\r"):
                lines[i] += 1
                dup[i] += line in seen
                seen.add(line)
    repeat = repeated_words(words.hash, words.doc, words.first, window_ok(words, REPEAT_WINDOW), REPEAT_WINDOW)
    return Stats(np.diff(words.first).astype(np.int64), _per_text(inside, offsets), _per_text(symbol[data], offsets), dup, lines, repeat)


def base_failed(s: Stats) -> np.ndarray:
    return (s.n_words < 20) | (100 * s.n_repeat_words > 30 * s.n_words)


class Rule(NamedTuple):
    """rejects(texts, rows of the statistics) -> booleans."""

    name: str
    rejects: Callable[[list[str], Stats], np.ndarray]


def _each(f: Callable[[str], bool]) -> Callable[[list[str], Stats], np.ndarray]:
    return lambda texts, s: np.fromiter((f(t) for t in texts), bool, len(texts))


def _few_letters(text: str) -> bool:
    words = text.split()
    return sum(_LETTER.search(w) is not None for w in words) < 0.6 * len(words)


def _no_frequent_word(text: str) -> bool:
    """Spaced prose of any language has a word that makes up 1 % of it or more; lists of codes, names or numbers have none."""
    words = text.lower().split()
    return len(words) >= 200 and 100 * max(Counter(words).values()) < len(words)


def _bullets(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) >= 5 and sum(x.lstrip().startswith(_BULLETS) for x in lines) > 0.9 * len(lines)


def _ellipses(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) >= 3 and sum(x.rstrip().endswith(("...", "…")) for x in lines) > 0.3 * len(lines)


def _monotone(text: str) -> bool:
    raw = text.encode()
    return len(raw) >= 500 and len(zlib.compress(raw, 1)) < 0.1 * len(raw)


RULES = (
    Rule("symbol_ratio", lambda t, s: s.n_symbols > 0.3 * s.n_words),
    Rule("word_length", lambda t, s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 20 * s.n_words)),
    Rule("duplicate_lines", lambda t, s: 2 * s.n_dup_lines > s.n_lines),
    Rule("few_letters", _each(_few_letters)),
    Rule("no_frequent_word", _each(_no_frequent_word)),
    Rule("bullets", _each(_bullets)),
    Rule("ellipses", _each(_ellipses)),
    Rule("monotone", _each(_monotone)),
)


def part_of(s: Stats, rows: np.ndarray) -> Stats:
    return Stats(*(x[rows] for x in s))


def plan(sample: list[str], rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Rule names by estimated rejections per second, best first."""
    if not sample:
        return [r.name for r in rules]
    data, offsets = text_buffer(pa.array(sample, pa.large_string()))
    s = statistics(sample, data, offsets)
    gain = {}
    for r in rules:
        began = time.perf_counter()
        rejected = int(r.rejects(sample, s).sum())
        gain[r.name] = (rejected + 1) / (len(sample) + 2) / max(1e-9, time.perf_counter() - began)
    return sorted(gain, key=lambda k: -gain[k])


def cascade(texts: list[str | None], s: Stats, order: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """kept, and the name of the first failed rule ('' if kept)."""
    by_name = {r.name: r for r in rules}
    why = np.where(base_failed(s), "base", "").astype(object)
    left = np.flatnonzero(~base_failed(s))
    for name in order:
        if not len(left):
            break
        bad = by_name[name].rejects([texts[i] or "" for i in left], part_of(s, left))
        why[left[bad]] = name
        left = left[~bad]
    kept = np.zeros(len(texts), bool)
    kept[left] = True
    return kept, why


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, sample_chars: int = 4000) -> DataFrame:
    """id, the base statistics, base_failed, kept and failed_rule of every document.

    The sample only orders the rules: `sample_rows` rows, and of each the first `sample_chars` code points.
    """
    source = pick(docs, id=id_col, text=text_col)
    ids = source.select("id").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = [r["t"] for r in source.join(F.broadcast(ids.distinct()), "id").select(F.substring("text", 1, sample_chars).alias("t")).limit(sample_rows).collect()]
    order = plan([t for t in sample if t])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                texts = part.column("text").to_pylist()
                s = statistics(texts, *text_buffer(part.column("text")))
                kept, why = cascade(texts, s, order)
                columns = [part.column("id"), *(pa.array(x, pa.int64()) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)), pa.array(base_failed(s)), pa.array(kept), pa.array(why, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string")
    return out.withColumnRenamed("id", id_col)


NAMES = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
