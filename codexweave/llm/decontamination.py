"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of every benchmark item; an item with fewer words
(but not none) is one window.  Patterns of one length m are searched together.  A shift table tells,
for the two words that end at the present position, how far every pattern still is from
ending there; positions that no pattern can end at are skipped, mostly m - 1 at a time.  At shift 0 the
same two words choose a bucket of patterns, and comparing word by word confirms an occurrence.

The benchmark goes to the tasks in blocks of about `block_bytes`; one block is the usual case, and a worker keeps its search tables from task to
task.  With more, the documents pass through CHAIN blocks at a time, one after the other in the same tasks and
without a shuffle.  After each chain the finds (documents with hits only) are written down, and the driver lets go of its blocks before it
fetches the next ones.  So no table, and nothing that the driver holds, grows with the benchmark beyond CHAIN blocks.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Defined results: null or empty text, and text without words: 0 words, nothing hit.  Items with null id or without
words give no patterns.  Items with equal texts are all reported.  Rows with equal ids are searched separately.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hold, maybe_among, numbered, pick, place, text_bytes

# What separates words after lower-casing A-Z.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(range(256))
for _b in range(ord("A"), ord("Z") + 1):
    _FOLD[_b] = _b + 32
for _b in _SEPARATORS:
    if not ord("A") <= _b <= ord("Z"):
        _FOLD[_b] = 0x20
FOLD = bytes(_FOLD)
#: Words that are looked at together; a longer text is searched in overlapping segments.
SEGMENT_BYTES = 8 << 20
#: Blocks of the benchmark that are in use at once, at most.
CHAIN = 4


def fold_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class WuManber:
    """Search tables for patterns (tuples of words) of one length."""

    def __init__(self, length: int, patterns: Iterable[tuple[bytes, ...]]):
        self.m = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(p[-self.block :], []).append(p)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        m, shift, default, n = self.m, self.shift, self.default, len(words)
        i = m - 1
        while i < n:
            key = (words[i - 1], words[i]) if self.block == 2 else (words[i],)
            step = shift.get(key, default)
            if step:
                i += step
                continue
            lo = i - m + 1
            for p in self.bucket[key]:
                if words[lo] == p[0] and tuple(words[lo : i + 1]) == p:
                    yield lo, p
            i += 1


class Searcher:
    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = fold_words(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                self.items.setdefault(tuple(words[i : i + m]), set()).add(item)
        lengths = sorted({len(p) for p in self.items})
        self.tables = [WuManber(m, [p for p in self.items if len(p) == m]) for m in lengths]
        self.longest = max(lengths, default=1)

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, disjoint spans (word index, end exclusive) that are hit, items."""
        raw = text.encode().translate(FOLD) if text else b""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        words: list[bytes] = []
        base, at = 0, 0  # words before the first of `words`; bytes done
        while at < len(raw):
            to = raw.find(b" ", at + SEGMENT_BYTES)
            to = len(raw) if to < 0 else to
            kept = words[max(0, len(words) - self.longest + 1) :]
            base += len(words) - len(kept)
            words = kept + raw[at:to].split()
            at = to
            for t in self.tables:
                for lo, p in t.occurrences(words):
                    found.append((base + lo, base + lo + t.m))
                    items |= self.items[p]
        return base + len(words), merge(found), items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


SPANS = "array<struct<lo:long,hi:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 2 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in `keep`, n_words, hit_spans (disjoint word spans), items (ids as strings) of every document."""
    marks = pick(benchmark, item=item_col, text=item_text_col).select(F.col("item").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    blocks = max(1, -(-text_bytes(marks) // block_bytes))
    names = list(dict.fromkeys([id_col, *keep]))
    cols: list[Column] = [place(docs, c).alias(f"__k{i}") for i, c in enumerate(names)]
    rows = numbered(docs).select(*cols, place(docs, text_col).alias("__text"), F.lit(0).cast("long").alias("n_words"))
    out = rows.withColumns({"hit_spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    finds: list[DataFrame] = []
    context = docs.sparkSession.sparkContext
    for first in range(0, blocks, CHAIN):
        last = first + CHAIN >= blocks
        searched = _with_finds(rows, finds) if last and finds else out
        held = []
        for b in range(first, min(blocks, first + CHAIN)):
            held.append(context.broadcast([(r["item"], r["text"]) for r in marks.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]))
            searched = searched.mapInArrow(_searching(held[-1], uuid.uuid4().hex, window), schema)
        if last:
            return searched.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)], "n_words", "hit_spans", "items")
        found = searched.filter(F.size("items") > 0)
        finds.append(checkpoint(found.select(F.col("__k0").alias("id"), F.xxhash64("__text").alias("key"), "hit_spans", "items")))
        for h in held:
            h.unpersist()


def _with_finds(rows: DataFrame, finds: list[DataFrame]) -> DataFrame:
    """rows with the spans and items found so far: at most one find of each chain for each document."""
    every = reduce(DataFrame.unionByName, finds).distinct()
    by_doc = checkpoint(every.groupBy("id", "key").agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items")))
    flagged = maybe_among(rows.withColumn("__key", F.xxhash64("__text")), "__key", by_doc.select("key"))
    none = {"hit_spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")}
    joined = flagged.filter("__among").join(by_doc, F.col("__k0").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key")), "left")
    touched = joined.select(*rows.columns, *[F.coalesce(c, e).alias(c) for c, e in none.items()])
    return flagged.filter(~F.col("__among")).select(*rows.columns).withColumns(none).unionByName(touched)


_known: dict[tuple[str, int], Searcher] = {}


def searcher(items: Broadcast, block: str, window: int) -> Searcher:
    """Search tables of a block, kept by the worker while it goes on with the same block."""
    if (block, window) not in _known:
        _known.clear()
        _known[block, window] = Searcher(items.value, window)
    return _known[block, window]


def _searching(block: Broadcast, name: str, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontamination", _known.clear)
        tables = searcher(block, name, window)
        for batch in batches:
            counts, spans, names = [], [], []
            before = zip(batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist())
            for text, (old, had) in zip(batch.column("__text"), before):
                n, hit, of = tables.search(text.as_py())
                counts.append(n)
                spans.append([{"lo": lo, "hi": hi} for lo, hi in merge([*((s["lo"], s["hi"]) for s in old), *hit])])
                names.append(sorted({*had, *of}))
            new = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, _SPAN_TYPE), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return run
