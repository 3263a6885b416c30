"""Where the terms of a dictionary stand in texts: one pass of an automaton over each text, whatever the number of terms.

A task gets the terms once, builds an Aho-Corasick automaton of them and runs every text through it; what comes back is, for each text, the terms with the
offsets of their occurrences (and the context around each, if wanted), so that neither texts nor pairs of texts and terms are multiplied.
A dictionary of up to BLOCK_ROWS terms and BLOCK_BYTES bytes is broadcast as one block.  A larger one is written down and goes in blocks by hash: the texts meet
as many blocks in one pass as CHAIN full ones hold, and are written between passes.  The result is the same for any number of blocks.

Occurrences are non-overlapping for each term by itself, leftmost first; terms do not exclude each other.  Offsets are in code points.
Null and empty texts hold nothing; null and empty terms stand nowhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .store import checkpoint

BLOCK_ROWS, BLOCK_BYTES = 100_000, 8 << 20
#: Full blocks that texts meet in one pass; smaller ones may be more.
CHAIN = 4
_HITS = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32())), ("context", pa.list_(pa.string()))]))
HITS = "array<struct<term:string,at:array<int>,context:array<string>>>"


class Finder:
    def __init__(self, terms: Iterable[str]):
        import ahocorasick

        self.terms = sorted(set(terms))
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[str, list[int]]:
        """The starts of each term's occurrences."""
        found: dict[int, list[int]] = {}
        free: dict[int, int] = {}  # where a term's last occurrence ends
        if self.terms:
            for end, (i, size) in self.automaton.iter(text):
                start = end - size + 1
                if start >= free.get(i, 0):
                    found.setdefault(i, []).append(start)
                    free[i] = end + 1
        return {self.terms[i]: at for i, at in sorted(found.items())}


_finders: dict[str, list[Finder]] = {}


def _finder(held: Broadcast, name: str) -> list[Finder]:
    """The automata of some blocks, kept by the worker while it goes on with the same blocks."""
    if name not in _finders:
        _finders.clear()
        _finders[name] = [Finder(block) for block in held.value]
    return _finders[name]


def snippet(text: str, start: int, size: int, pad: int, marks: tuple[str, str]) -> str:
    return f"{text[max(0, start - pad):start]}{marks[0]}{text[start:start + size]}{marks[1]}{text[start + size:start + size + pad]}"


def _adding(held: Broadcast, name: str, text_at: int, pad: int | None, marks: tuple[str, str]):
    """Batches whose last column holds hits -> the same with the hits of these blocks added.  What was found before stays in Arrow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = _finder(held, name)
        for batch in batches:
            had = batch.column(batch.num_columns - 1)
            rows = []
            for text in batch.column(text_at).to_pylist():
                value = text or ""
                rows.append([(t, at, None if pad is None else [snippet(value, s, len(t), pad, marks) for s in at]) for f in finders for t, at in f.find(value).items()] if value else [])
            new = pa.array(rows, _HITS)
            if len(had.flatten()):
                # each text's hits of before and then its new ones: both lists' values one after the other, taken in that order
                sizes = [np.diff(x.offsets.to_numpy()) for x in (had, new)]
                owner = np.concatenate([np.repeat(np.arange(len(rows)), n) for n in sizes])
                order = np.argsort(owner, kind="stable")
                values = pa.concat_arrays([had.flatten().cast(_HITS.value_type), new.flatten()]).take(pa.array(order))
                new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], names=batch.schema.names)

    return run


def passes(parts: Iterable[list[str]]) -> Iterator[list[list[str]]]:
    """Blocks that texts meet in one pass: together within CHAIN blocks of full size, whatever the blocks' number."""
    held, n, size = [], 0, 0
    for block in parts:
        chars = sum(map(len, block))
        if held and (n + len(block) > CHAIN * BLOCK_ROWS or size + chars > CHAIN * BLOCK_BYTES):
            yield held
            held, n, size = [], 0, 0
        held, n, size = [*held, block], n + len(block), size + chars
    if held:
        yield held


def all_rows(terms: DataFrame, term: str, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> list[Row] | None:
    """The rows of a dictionary that is small enough for one block; None for a larger one."""
    rows = terms.limit(block_rows + 1).collect()
    return rows if len(rows) <= block_rows and sum(len(r[term] or "") for r in rows) <= block_bytes else None


def blocks(terms: DataFrame, term: str, block_rows: int, block_bytes: int) -> Iterator[list[str]]:
    """The terms of a large dictionary in blocks; each is let go of by the driver before the next one is fetched."""
    every = checkpoint(terms.select(F.col(term).cast("string").alias("t")).filter(F.length("t") > 0).distinct())
    n, size = every.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    parts = max(1, -(-2 * n // block_rows), -(-2 * (size or 0) // block_bytes))  # half full on average, so that hashing keeps them within bounds
    part = F.pmod(F.xxhash64("t"), F.lit(parts))
    dealt = every if parts == 1 else checkpoint(every.repartition(min(parts, 2000), part))
    for p in range(parts):
        yield [r["t"] for r in dealt.filter(part == p).collect()]


def find_terms(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", keep: Sequence[str] | None = None, pad: int | None = None, marks: tuple[str, str] = ("〔", "〕"), block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, rows: list[Row] | None = None) -> DataFrame:
    """`keep` (all columns of texts, if not given) and `hits`: of each term that the text holds its offsets, and with `pad` the context of each.
    `rows` are all rows of terms, if they have been fetched already."""
    keep = list(texts.columns if keep is None else keep)
    # Columns go by place, so that no name can clash.
    out = texts.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("t"), F.array().cast(HITS).alias("hits"))
    context = texts.sparkSession.sparkContext
    rows = all_rows(terms.select(term), term, block_rows, block_bytes) if rows is None else rows
    parts = blocks(terms, term, block_rows, block_bytes) if rows is None else [[r[term] for r in rows if r[term]]]
    for i, held in enumerate(passes(parts)):
        if i:
            out = checkpoint(out)
        out = out.mapInArrow(_adding(context.broadcast(held), uuid.uuid4().hex, len(keep), pad, marks), out.schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "hits")


def with_longest(texts: DataFrame, terms: DataFrame, text: str, term: str, name: str, **options) -> DataFrame:
    """texts with `name`: the longest term that the text holds (of equally long ones the greatest), or null."""
    found = find_terms(texts, terms, text, term, **options)
    size = F.transform("hits", lambda h: F.struct(F.length(h["term"]).alias("n"), h["term"].alias("term")))
    return found.withColumn(name, F.array_max(size)["term"]).drop("hits")
