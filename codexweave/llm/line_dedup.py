"""Line dedup: lines that stand in many documents, dropped by per-document keep bitmaps.

A document gives one row for every distinct key of its lines, with a 128-bit hash of the key and the line numbers; texts stay where
they are.  These rows are dealt to ranges of (hash, document) and sorted by hash, document and position, so that a key's
first occurrence in each document streams by in order.  A task counts documents while the run of a key passes and holds back fewer than
`min_docs` rows of it; once the count is reached, the rest of the run goes through.  A key of very many documents is in many
ranges: only the runs at the two edges of a range are unsure, and a range reports each of them with its count and at most
`min_docs` rows, so what has to be settled between ranges is bounded by their number.

The answer is a keep bitmap per document that loses a line: one bit a line, packed and deflated.  `apply` puts bitmaps and
texts together; texts that surely lose nothing are not shuffled.

A key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased.  Documents are told apart by id and a 64-bit hash of the text.

Defined results: null and empty texts have one empty line.  Blank lines have no key and always stay.  A line that comes twice in one document
counts once.  Rows equal in id and text count as one document and get the same bitmap; rows with equal id and other text are documents of their own, and
so is null as an id.  A document that loses all lines has an empty text.  Columns besides id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checkpoint, maybe_among, measured, pick, shuffle_partitions
from .words import SPACE_BYTES, separator_table, slices_by_bytes, split_words, text_buffer

_NEWLINE = 0x0A
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Another order of the bytes, newline apart, under which a second, independent hash is taken.
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[np.arange(256) != _NEWLINE] = np.random.Generator(np.random.PCG64(7)).permutation(np.delete(np.arange(256, dtype=np.uint8), _NEWLINE))
_SPACE, _LINE = separator_table(SPACE_BYTES), separator_table(bytes([_NEWLINE]))


def stripped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts whose lines have no white space at their ends, and their offsets."""
    blank = _SPACE[data] & (data != _NEWLINE)
    at = np.flatnonzero(blank)
    solid = np.flatnonzero(~blank)
    stop = np.append(data[solid] != _NEWLINE, False)  # a newline, or nothing, on that side
    right = np.searchsorted(solid, at)
    end = np.searchsorted(offsets, at, "right")  # of the text that the byte is in
    before = (right > 0) & stop[right - 1] & (solid[right - 1] >= offsets[end - 1]) if len(solid) else np.zeros(len(at), bool)
    after = stop[right] & (np.append(solid, len(data))[right] < offsets[end])
    keep = ~blank
    keep[at[before & after]] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return _FOLD[data[keep]], kept_before[offsets]


def keys(column: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every distinct key of every text: text index, two hashes, offsets into the line numbers; the line numbers."""
    data, offsets = stripped(*text_buffer(column))
    lines = split_words(data, offsets, _LINE)
    other = split_words(_OTHER[data], offsets, _LINE).hash
    newlines = np.flatnonzero(data == _NEWLINE)
    number = np.searchsorted(newlines, lines.start) - np.searchsorted(newlines, offsets[:-1])[lines.doc]
    doc, one, two = lines.doc, lines.hash, other
    if min_chars > 1:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = points[lines.end] - points[lines.start] >= min_chars
        doc, one, two, number = doc[long], one[long], two[long], number[long]
    order = np.lexsort((number, two, one, doc))
    doc, one, two, number = doc[order], one[order], two[order], number[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(new)
    return doc[first], one[first].view(np.int64), two[first].view(np.int64), np.append(first, len(doc)), number


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """k1, k2, id, th, lines: the line numbers of each key in each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                doc, one, two, offsets, number = keys(part.column("text"), min_chars)
                lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(number, pa.int32()))
                at = pa.array(doc, pa.int64())
                for lo in range(0, len(doc), 1 << 15):
                    some = at.slice(lo, 1 << 15)
                    yield pa.RecordBatch.from_arrays([pa.array(one).slice(lo, 1 << 15), pa.array(two).slice(lo, 1 << 15), part.column("id").take(some), part.column("th").take(some), lines.slice(lo, 1 << 15)], names=["k1", "k2", "id", "th", "lines"])

    return docs.mapInArrow(run, f"k1 long, k2 long, id {docs.schema['id'].dataType.simpleString()}, th long, lines array<int>")


class _Run:
    """The rows of one key as they stream by, across batches."""

    def __init__(self, key: tuple[int, int] | None, at_edge: bool):
        self.key, self.at_edge, self.n = key, at_edge, 0
        self.held: list[tuple[pa.RecordBatch, np.ndarray]] = []  # rows that wait for the count, of fewer documents than min_docs, and which are of the first
        self.last: tuple | None = None  # id and th of the latest row


_DROP, _OPEN, _EDGE = 0, 1, 2


def _streaming(min_docs: int, keep_first: bool, names: list[str]):
    """Rows in order of (k1, k2, id, th) -> rows that lose lines (_DROP), rows that wait for a verdict between ranges (_OPEN), counts of the runs at edges (_EDGE)."""

    def rows(kind: int, batch: pa.RecordBatch, first: np.ndarray | bool) -> pa.RecordBatch:
        n = batch.num_rows
        part = TaskContext.get().partitionId()
        extra = [pa.array(np.full(n, kind, np.int32)), pa.array(np.broadcast_to(np.asarray(first, bool), n).copy()), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, part, np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "kind", "first", "n", "part"])

    def edge(run: _Run, template: pa.RecordBatch) -> pa.RecordBatch:
        cols = [pa.array([run.key[0]], pa.int64()), pa.array([run.key[1]], pa.int64()), *[pa.nulls(1, template.schema.field(c).type) for c in names[2:]]]
        extra = [pa.array([_EDGE], pa.int32()), pa.array([False]), pa.array([run.n], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int32())]
        return pa.RecordBatch.from_arrays([*cols, *extra], names=[*names, "kind", "first", "n", "part"])

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, template = None, None

        def close(ends: bool) -> Iterator[pa.RecordBatch]:
            """The run is over, by another key or (ends) by the end of the range."""
            unsure = run.at_edge or ends
            if unsure:
                yield edge(run, template)
            if run.held and unsure and run.n < min_docs:
                for b, leads in run.held:
                    yield rows(_OPEN, b, leads)

        for batch in batches:
            if not batch.num_rows:
                continue
            template = batch
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            th = batch.column("th").to_numpy(zero_copy_only=False)
            ids = batch.column("id")
            n = batch.num_rows
            new_key = np.ones(n, bool)
            new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new_doc = np.ones(n, bool)
            same_id = pc.equal(ids.slice(1), ids.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            if ids.null_count:
                none = ids.is_null().to_numpy(zero_copy_only=False)
                same_id |= none[1:] & none[:-1]
            new_doc[1:] = new_key[1:] | ~same_id | (th[1:] != th[:-1])
            bounds = np.append(np.flatnonzero(new_key), n)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if len(bounds) < 64 else _few(bounds, new_doc, min_docs):
                key = (int(k1[lo]), int(k2[lo]))
                if run is None or key != run.key:
                    if run is not None:
                        yield from close(False)
                    run = _Run(key, run is None)
                fresh = new_doc[lo:hi].copy()
                if run.last is not None and run.last == (ids[lo].as_py(), int(th[lo])):
                    fresh[0] = False
                # The first document of a run keeps its first line (keep_first), unless ranges before this one have rows of the key.
                run.held.append((batch.slice(lo, hi - lo), run.n + np.cumsum(fresh) == 1))
                run.n += int(fresh.sum())
                run.last = (ids[hi - 1].as_py(), int(th[hi - 1]))
                if run.n < min_docs:
                    continue
                waiting, run.held = run.held, []
                for b, leads in waiting:
                    k = int(leads.sum()) if keep_first and run.at_edge else 0
                    if k:
                        yield rows(_OPEN, b.slice(0, k), True)
                    if k < b.num_rows:
                        yield rows(_DROP, b.slice(k), leads[k:])
        if run is not None:
            yield from close(True)

    return go


def _few(bounds: np.ndarray, new_doc: np.ndarray, min_docs: int) -> Iterator[tuple[int, int]]:
    """The runs of a batch that matter: those at its two ends, and between them those that reach the count.  The others are over, and too small."""
    lo, hi = bounds[:-1], bounds[1:]
    count = np.add.reduceat(new_doc.astype(np.int64), lo)
    some = count >= min_docs
    some[[0, -1]] = True
    yield from zip(lo[some].tolist(), hi[some].tolist())


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """id, th (xxhash64 of the text), n_dropped, keep: of every document that loses lines, a deflated bitmap of the lines that stay.

    Keys of at least `min_chars` code points in at least `min_docs` documents lose all their lines, or with keep_first all but
    the first one of the first document.  Bits beyond the bitmap's end are lines that stay.
    """
    rows = _identified(docs, id_col, text_col)
    found = checkpoint(occurrences(rows, min_chars))
    order = ["k1", "k2", "id", "th"]
    ranged = found.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", kind int, first boolean, n long, part int"
    streamed = checkpoint(ranged.mapInArrow(_streaming(min_docs, keep_first, found.columns), schema))
    # At most two runs and 2 * min_docs rows of each range are unsure; the table of their counts is bounded by the number of ranges.
    totals = streamed.filter(F.col("kind") == _EDGE).groupBy("k1", "k2").agg(F.sum("n").alias("total"), F.min("part").alias("least"))
    settled = streamed.filter(F.col("kind") == _OPEN).join(F.broadcast(totals), ["k1", "k2"]).filter(F.col("total") >= min_docs)
    settled = settled.select("id", "th", "lines", (F.col("first") & (F.col("part") == F.col("least"))).alias("first"))
    dropped = streamed.filter(F.col("kind") == _DROP).select("id", "th", "lines", "first").unionByName(settled)
    if keep_first:
        dropped = dropped.withColumn("lines", F.when(F.col("first"), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))).filter(F.size("lines") > 0)
    by_doc = dropped.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for own in batch.column("lines"):
                at = own.values.to_numpy()
                bits = np.ones(int(at.max()) + 1, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes() + bytes([-len(bits) % 8])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pc.list_value_length(batch.column("lines")).cast(pa.int64()), pa.array(maps, pa.binary())], names=["id", "th", "n_dropped", "keep"])

    return by_doc.mapInArrow(pack, f"id {found.schema['id'].dataType.simpleString()}, th long, n_dropped long, keep binary")


def unpack(keep: bytes) -> np.ndarray:
    """The bits of a bitmap: whether each line stays."""
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    return bits[: len(bits) - raw[-1]].astype(bool)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("th"), "text")


def kept_lines(text: str, keep: bytes) -> str:
    lines, bits = text.split("\n"), unpack(keep)
    return "\n".join([*compress(lines, bits), *lines[len(bits) :]])


def apply(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, kept of every row of docs; `maps` are the bitmaps of these documents."""
    maps, seen = measured(maps.withColumn("__key", F.xxhash64("id", "th")), n=F.count(F.lit(1)))
    rows = _identified(docs, id_col, text_col).withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long"))
    flagged = maybe_among(rows.withColumn("__key", F.xxhash64("id", "th")), "__key", maps.select("__key"), seen["n"])
    whole = flagged.filter(~F.col("__among")).select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept"))
    right = maps.select("__key", F.col("id").alias("of"), F.col("th").alias("of_th"), "n_dropped", "keep").hint("shuffle_hash")
    same = (flagged["__key"] == right["__key"]) & F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th"))
    met = flagged.filter("__among").join(right, same, "left").select("id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                texts = zip(part.column("text").to_pylist(), part.column("keep").to_pylist())
                kept = [t or "" if k is None else kept_lines(t or "", k) for t, k in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(kept, pa.string())], names=["id", "n_lines", "n_dropped", "kept"])

    cut = met.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """id, n_lines (before), n_dropped, kept: every text without the lines that stand in at least `min_docs` documents."""
    return apply(docs, bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first), id_col, text_col)
