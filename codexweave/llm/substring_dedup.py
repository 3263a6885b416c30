"""Exact substring deduplication with fixed-block anchors.

A window is `window` consecutive words of one document (50).  A word goes if a window that covers it also starts in a
document with a smaller id.  Windows are judged on the input.

1.  Index and probe.  Every document is cut into non-overlapping reference blocks of half a window (25 words), so
    each window holds a whole block wherever it starts.  Blocks are the index; every rolling window of 25 words is a
    probe.  Both go, as 4-byte fingerprints, to hash buckets; a fingerprint that has a block and is found
    in two documents or more is an anchor, and its documents learn of it.
2.  Extend.  Only windows of 50 words around anchors are candidates.  These go, as 8-byte hashes (with the bucket, an
    independent hash, 80 bits or more in large corpora), to buckets that find the smallest document
    of each.  Neighbouring windows with a smaller document merge into maximal repeats.
3.  Cut.  The words of these windows leave the text.

Load.  Payloads are binary columns, one row for each slice of text and bucket; answers come back packed by groups of
documents.  Before anything is sent, each
slice sums up its own equal fingerprints, so a passage that a third of all documents share costs a bucket
one entry per slice and not one per document.  The number of buckets follows the amount of text.  Documents
without anchors are told apart by a bitmap (64 MB at most, at any corpus size) and are not shuffled; a false
alarm there costs work only.

Defined results: null text has no words.  A row with null id keeps its text and removes nothing.  Rows with equal ids
are one document for the rule; each gets its own result row.  Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checkpoint, maybe_among, pick, shuffle_partitions, text_bytes
from .words import Words, separator_table, slices_by_bytes, split_words, text_buffer, window_hash, window_ok

_TABLE = separator_table()
#: Of a slice's fingerprints without a block there, those in fewer entries are sent one by one.
LOCAL_MANY = 8
#: Text that one bucket stands for.
BUCKET_BYTES = 32 << 20

PAYLOAD = "bucket int, hit boolean, hashes binary, docs binary, counts binary, blocks binary, shared binary"
_PAYLOAD = pa.schema([("bucket", pa.int32()), ("hit", pa.bool_()), *((c, pa.binary()) for c in ("hashes", "docs", "counts", "blocks", "shared"))])
#: What a bucket answers: packed by groups of documents, one row for each bucket and group.
HITS = "bucket int, hashes binary, docs binary, counts binary"
_HITS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "docs", "counts"))])
BY_DOC = "doc long, hashes binary"


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _pieces(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values cut at starts, as binaries."""
    offsets = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _packed(docs: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Group, hashes, documents and counts of documents' hits, one tuple for each group of documents."""
    group = (((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((docs, group))
    group, docs, hashes = group[order], docs[order], hashes[order]
    starts = np.append(_runs(group), len(group))
    for lo, hi in zip(starts[:-1], starts[1:]):
        runs = _runs(docs[lo:hi])
        yield int(group[lo]), hashes[lo:hi].tobytes(), docs[lo:hi][runs].tobytes(), np.diff(np.append(runs, hi - lo)).astype(np.uint32).tobytes()


def _hit_rows(docs: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    rows = [dict(zip(("bucket", "hashes", "docs", "counts"), r)) | {"hit": True} for r in _packed(docs, hashes, buckets)]
    return pa.RecordBatch.from_pylist(rows, schema=_PAYLOAD)


def _answers(passed: pa.Table, docs: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.Table:
    rows = [dict(zip(("bucket", "hashes", "docs", "counts"), r)) for r in _packed(docs, hashes, buckets)]
    return pa.concat_tables([passed.cast(_HITS), pa.Table.from_pylist(rows, schema=_HITS)])


def _bucket_rows(bucket: np.ndarray, doc: np.ndarray, hashes: np.ndarray, block: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((doc, bucket))
    bucket, doc, hashes, block, shared = (x[order] for x in (bucket, doc, hashes, block, shared))
    starts = np.append(_runs(bucket), len(bucket))
    for lo, hi in zip(starts[:-1], starts[1:]):
        runs = _runs(doc[lo:hi])
        counts = np.diff(np.append(runs, hi - lo)).astype(np.uint32)
        row = [int(bucket[lo]), False, hashes[lo:hi].tobytes(), doc[lo:hi][runs].tobytes(), counts.tobytes(), np.packbits(block[lo:hi]).tobytes(), np.packbits(shared[lo:hi]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PAYLOAD)], schema=_PAYLOAD)


def _read_bucket(rows: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, docs, block and shared flags of all payload rows of a bucket."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for hashes, docs, counts, blocks, shared in zip(*(rows.column(c) for c in ("hashes", "docs", "counts", "blocks", "shared"))):
        h = np.frombuffer(hashes.as_buffer(), kind)
        parts[0].append(h)
        parts[1].append(np.repeat(np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.uint32)))
        for i, bits in ((2, blocks), (3, shared)):
            parts[i].append(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(h)).astype(bool))
    return tuple(np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (kind, np.int64, bool, bool)))


def _words_of(part: pa.RecordBatch) -> Words:
    return split_words(*text_buffer(part.column("text")), _TABLE)


def _probing(window: int, buckets: int):
    half = window // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                words = _words_of(part)
                h = window_hash(words.hash, half)
                at = np.flatnonzero(window_ok(words, half) & (np.diff(words.first) >= window)[words.doc[: len(h)]])
                if not len(at):
                    continue
                row = words.doc[at]
                doc = part.column("doc").to_numpy(zero_copy_only=False)[row]
                block = (at - words.first[row]) % half == 0
                order = np.argsort(h[at])
                h, doc, block = h[at][order], doc[order], block[order]
                starts = _runs(h)
                size = np.diff(np.append(starts, len(h)))
                least, most = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
                blocked = np.logical_or.reduceat(block, starts)
                several = least != most
                local = several & (blocked | (size >= LOCAL_MANY))  # anchors already, as far as this slice goes
                if local.any():
                    mine = np.repeat(local, size)
                    yield _hit_rows(doc[mine], (h[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32), buckets)
                one = local | ~several  # one entry stands for all
                rest = np.repeat(~one, size)
                sent = np.concatenate([h[starts[one]], h[rest]])
                yield from _bucket_rows(
                    ((sent >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32),
                    np.concatenate([least[one], doc[rest]]),
                    (sent & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                    np.concatenate([blocked[one], block[rest]]),
                    np.concatenate([local[one], np.zeros(rest.sum(), bool)]),
                )

    return run


def _split_hits(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    mask = rows.column("hit")
    return rows.filter(mask).select(_HITS.names), rows.filter(pa.compute.invert(mask))


def _anchors(buckets: int):
    """Documents and fingerprints of the anchors of a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        passed, probes = _split_hits(rows)
        h, doc, block, shared = _read_bucket(probes, np.uint32)
        if not len(h):
            return passed.cast(_HITS)
        order = np.argsort(h)
        h, doc, block, shared = h[order], doc[order], block[order], shared[order]
        starts = _runs(h)
        several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | np.logical_or.reduceat(shared, starts)
        anchor = several & np.logical_or.reduceat(block, starts)
        mine = np.repeat(anchor, np.diff(np.append(starts, len(h)))) & ~shared
        return _answers(passed, doc[mine], h[mine], buckets)

    return run


def _by_doc(kind: type):
    """One row for each document of a group: all its hashes."""

    def run(rows: pa.Table) -> pa.Table:
        docs = np.concatenate([np.repeat(np.frombuffer(d.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.uint32)) for d, c in zip(rows.column("docs"), rows.column("counts"))])
        hashes = np.concatenate([np.frombuffer(h.as_buffer(), kind) for h in rows.column("hashes")])
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
        new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])])
        docs, hashes = docs[new], hashes[new]
        starts = _runs(docs)
        return pa.table({"doc": pa.array(docs[starts]), "hashes": _pieces(hashes, starts)})

    return run


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and the row of each."""
    values = [np.frombuffer(b.as_buffer(), kind) if b.is_valid else np.zeros(0, kind) for b in column]
    return np.concatenate(values), np.repeat(np.arange(len(values)), [len(v) for v in values])


def _extending(window: int, buckets: int):
    half = window // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                words = _words_of(part)
                n = len(words.hash) - window + 1
                if n <= 0:
                    continue
                prints, of = _joined(part.column("hashes"), np.uint32)
                known = np.unique((of.astype(np.uint64) << np.uint64(32)) | prints)
                mine = (words.doc.astype(np.uint64) << np.uint64(32))[: n + window - half] | (window_hash(words.hash, half) & np.uint64(0xFFFFFFFF))
                near = np.concatenate([[0], np.cumsum(np.isin(mine, known))])
                at = np.flatnonzero(window_ok(words, window) & (near[window - half + 1 :][:n] > near[:n]))
                if not len(at):
                    continue
                h = window_hash(words.hash, window)[at]
                other = window_hash(words.hash, window, seed=1)[at]
                doc = part.column("doc").to_numpy(zero_copy_only=False)[words.doc[at]]
                order = np.argsort(h)
                h, other, doc = h[order], other[order], doc[order]
                starts = _runs(h)
                least = np.minimum.reduceat(doc, starts)
                later = doc > np.repeat(least, np.diff(np.append(starts, len(h))))
                if later.any():
                    yield _hit_rows(doc[later], h[later], buckets)
                none = np.zeros(len(starts), bool)
                yield from _bucket_rows((other[starts] % np.uint64(buckets)).astype(np.int32), least, h[starts], none, none)

    return run


def _repeats(buckets: int):
    """Documents and windows of a bucket that a smaller document has, too."""

    def run(rows: pa.Table) -> pa.Table:
        passed, sent = _split_hits(rows)
        h, doc, _, _ = _read_bucket(sent, np.uint64)
        if not len(h):
            return passed.cast(_HITS)
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        starts = _runs(h)
        later = doc > np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
        return _answers(passed, doc[later], h[later], buckets)

    return run


CUT = "n_words long, n_removed long, kept string, spans array<struct<lo:long,hi:long>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _cutting(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                texts = part.column("text").to_pylist()
                kept = [b" ".join((t or "").encode().split()) for t in texts]
                n_words = [k.count(b" ") + 1 if k else 0 for k in kept]
                removed, spans = [0] * len(texts), [[] for _ in texts]
                gone, of = _joined(part.column("hashes"), np.uint64)
                for i in np.unique(of):
                    data, offsets = text_buffer(pa.array([texts[i]], pa.large_string()))
                    words = split_words(data, offsets, _TABLE)
                    at = np.flatnonzero(np.isin(window_hash(words.hash, window), gone[of == i]))
                    edge = np.zeros(len(words.hash) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    raw = data.tobytes()
                    kept[i] = b" ".join([raw[s:e] for s, e in zip(words.start[~out].tolist(), words.end[~out].tolist())])
                    removed[i] = int(out.sum())
                    change = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                    spans[i] = [{"lo": lo, "hi": hi} for lo, hi in zip(change[::2].tolist(), change[1::2].tolist())]
                columns = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], names=[*part.schema.names[:-2], "n_words", "n_removed", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """id, n_words, n_removed, kept (kept words joined by one space), spans (maximal removed word spans, end exclusive)."""
    if window % 2:
        raise ValueError("the window must be even: blocks are half a window")
    rows = pick(docs, doc=id_col, text=text_col)
    named = rows.select(F.col("doc").cast("long").alias("doc"), "text").filter("doc is not null and text is not null")
    buckets = max(shuffle_partitions(docs.sparkSession), -(-text_bytes(rows) // BUCKET_BYTES))
    probes = named.mapInArrow(_probing(window, buckets), PAYLOAD)

    def gathered(payload: DataFrame, answer, kind: type) -> DataFrame:
        """Answers of all buckets, one row for each document."""
        answers = payload.groupBy("bucket").applyInArrow(answer(buckets), HITS)
        return checkpoint(answers.groupBy("bucket").applyInArrow(_by_doc(kind), BY_DOC))

    anchors = gathered(probes, _anchors, np.uint32)
    near = maybe_among(named, "doc", anchors.select("doc")).filter("__among").drop("__among").join(anchors, "doc")
    extended = near.select("doc", "text", "hashes").mapInArrow(_extending(window, buckets), PAYLOAD)
    repeats = gathered(extended, _repeats, np.uint64)
    flagged = maybe_among(rows.withColumn("key", F.col("doc").cast("long")), "key", repeats.select("doc"))
    gone = repeats.withColumnRenamed("doc", "key")
    touched = flagged.filter("__among").join(gone, "key", "left").select("doc", "text", "hashes")
    rest = flagged.filter(~F.col("__among")).select("doc", "text", F.lit(None).cast("binary").alias("hashes"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rest.unionByName(touched).mapInArrow(_cutting(window), f"doc {kind}, {CUT}").withColumnRenamed("doc", id_col)
