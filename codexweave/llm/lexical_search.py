"""Ranked lexical search: every document scored for every item, work that items share done once.

Items are queries of many terms, and frequent terms stand in most of them.  From the items' term sets, each in order of how many items
hold a term, pairs of neighbours that stand in several items are merged into nodes, and pairs of nodes again, round by round, so that a
node is a term set shared by at least two items and the items are short lists of nodes: a query-sharing DAG.  A batch of documents gets one accumulator
per term and node: a node's is the sum of its two parts, computed once whatever the number of items, and an item's score is the sum over its list.
Scores are integers, so sums in any order are equal.

Texts are read once for each block of items: terms are found by 128-bit hashes and written down as postings (id, length, terms,
counts), from which document frequencies are counted and then scores.  Each task keeps `top` rows of an item; only those are shuffled.  A block of items
holds about `block_bytes` of text; its terms, weights and DAG are all that is broadcast.  Blocks are written to the checkpoint folder once and read one by one.

Terms: maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased.  With N documents that have terms, L terms in all of them, n in a
document and df documents that hold a term: w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 10 + (90 * n * N) div L, and the score is the sum over
the item's terms, once each, of w * ((10^9 * tf) div (1000 * tf + 8 * m)).

Defined results: null and empty texts, and texts without terms, are not counted and never found.  An item without terms, or found nowhere, has no rows.  Rows with equal item
ids are one item with the terms of all; a null item id is an item.  Documents with equal ids are ranked separately.  Equal scores rank by ascending document id, null last.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, blocks_of, checkpoint, hold, pick
from .words import Words, separator_table, slices_by_bytes, split_words, text_buffer

# The bytes that separate terms.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_BREAK = separator_table(_SEPARATORS)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Another order of the bytes of terms, under which a second, independent hash is taken.
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[~_BREAK] = np.random.Generator(np.random.PCG64(11)).permutation(_OTHER[~_BREAK])
#: Bytes of accumulators that a task fills at once.
ACCUMULATOR_BYTES = 24 << 20


def terms_of(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The terms of a batch of texts with two hashes each."""
    data, offsets = text_buffer(column)
    data = _FOLD[data]
    return split_words(data, offsets, _BREAK), split_words(_OTHER[data], offsets, _BREAK).hash


class Items(NamedTuple):
    """A block of items: the hashes of its terms in order, and the terms of each item as places in them."""

    ids: list
    one: np.ndarray
    two: np.ndarray
    terms: np.ndarray  # of item i: terms[starts[i] : starts[i + 1]]
    starts: np.ndarray


def items_of(rows: list[tuple]) -> Items:
    """(id, text) of a block -> its items; those without terms are left out."""
    words, two = terms_of(pa.array([t for _, t in rows], pa.string()))
    names: dict = {}
    owner = np.array([names.setdefault(i, len(names)) for i, _ in rows], np.int64)
    both, at = np.unique(np.stack([words.hash, two]), axis=1, return_inverse=True)
    pairs = np.unique(np.stack([owner[words.doc] if len(rows) else words.doc, at.ravel()]), axis=1)
    used, starts = np.unique(pairs[0], return_index=True)
    ids = list(names)
    return Items([ids[i] for i in used], both[0], both[1], pairs[1], np.append(starts, pairs.shape[1]))


class Plan(NamedTuple):
    """The DAG: node len(terms) + i is the sum of left[i] and right[i]; an item is the sum of its list of nodes."""

    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]  # ranges of nodes whose parts are all of earlier ranges
    nodes: np.ndarray
    starts: np.ndarray


def share(terms: np.ndarray, starts: np.ndarray, n_terms: int) -> Plan:
    """Mine term sets that items share.  Linear in the terms of the items, for each of a few rounds."""
    many = np.bincount(terms, minlength=n_terms)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((terms, -many[terms], owner))
    seq, owner = terms[order].astype(np.int64), owner[order]
    left, right, levels, size = [], [], [], n_terms
    while len(seq) > 1:
        within = owner[1:] == owner[:-1]
        code = np.where(within, seq[:-1] * size + seq[1:], -1)
        kinds, kind, count = np.unique(code, return_inverse=True, return_counts=True)
        # A pair is taken where it stands in more items than the pairs that overlap it (of equal ones the first kind).
        rank = np.zeros(len(kinds), np.int64)
        rank[np.lexsort((-kinds, count))] = np.arange(len(kinds))
        worth = np.where(within & (count[kind] > 1), rank[kind] + 1, 0)
        take = (worth > 0) & (worth > np.append(0, worth[:-1])) & (worth >= np.append(worth[1:], 0))
        take[1:] &= ~take[:-1]
        taken = np.bincount(kind[take], minlength=len(kinds))
        take &= taken[kind] > 1
        if not take.any():
            break
        made = np.flatnonzero((taken > 1) & (kinds >= 0))
        name = np.full(len(kinds), -1, np.int64)
        name[made] = size + np.arange(len(made))
        left.append(kinds[made] // size)
        right.append(kinds[made] % size)
        levels.append((size, size + len(made)))
        size += len(made)
        at = np.flatnonzero(take)
        seq[at] = name[kind[at]]
        gone = np.zeros(len(seq), bool)
        gone[at + 1] = True
        seq, owner = seq[~gone], owner[~gone]
    none = np.zeros(0, np.int64)
    return Plan(np.concatenate([none, *left]), np.concatenate([none, *right]), levels, seq, np.searchsorted(owner, np.arange(len(starts) - 1)))


def accumulate(plan: Plan, n_terms: int, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Scores (items, docs), from the value of every posting."""
    acc = np.zeros((n_terms + len(plan.left), docs), np.int64)
    acc[term, doc] = value
    for lo, hi in plan.levels:
        a, b = lo - n_terms, hi - n_terms
        np.add(acc[plan.left[a:b]], acc[plan.right[a:b]], out=acc[lo:hi])
    return np.add.reduceat(acc[plan.nodes], plan.starts, axis=0) if len(plan.starts) else np.zeros((0, docs), np.int64)


_known: dict[str, Items] = {}


def _items(block: Broadcast, name: str) -> Items:
    if name not in _known:
        _known.clear()
        _known[name] = block.value
    return _known[name]


def postings(docs: DataFrame, block: Broadcast) -> DataFrame:
    """id, n, terms (places among the block's), counts of every document that has a term."""
    name = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("lexical_search", _known.clear)
        items = _items(block, name)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                words, two = terms_of(part.column("text"))
                at = np.minimum(np.searchsorted(items.one, words.hash), max(len(items.one) - 1, 0))
                hit = np.zeros(len(two), bool)
                if len(items.one):
                    hit = (items.one[at] == words.hash) & (items.two[at] == two)
                code, tf = np.unique(words.doc[hit] * max(len(items.one), 1) + at[hit], return_counts=True)
                doc, term = np.divmod(code, max(len(items.one), 1))
                n = np.diff(words.first)
                some = np.flatnonzero(n)
                offsets = pa.array(np.append(np.searchsorted(doc, some), len(doc)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(some)), pa.array(n[some], pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


class Model(NamedTuple):
    plan: Plan
    weights: np.ndarray
    documents: int
    length: int
    items: int


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def scale(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of documents with n terms; in Python's integers where 64 bits would not do."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * k * documents // length for k in n.tolist()], np.int64)
    return 10 + 90 * n * documents // length


def best(table: pa.Table, top: int) -> pa.Table:
    """The `top` rows of every item, by score and then id."""
    table = table.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])  # nulls come last
    item = table.column("item").to_numpy()
    first = np.searchsorted(item, item)
    return table.filter(pa.array(np.arange(len(item)) - first < top))


def _scoring(model: Broadcast, top: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        terms = len(m.weights)
        width = max(1, ACCUMULATOR_BYTES // (8 * (terms + len(m.plan.left) + len(m.plan.nodes) + m.items + 1)))
        least = np.ones(m.items, np.int64)  # what a score must reach
        kept: pa.Table | None = None
        waiting: list[pa.Table] = []
        rows = 0

        def settle() -> pa.Table:
            table = best(pa.concat_tables([*([kept] if kept is not None else []), *waiting]), top)
            item, score = table.column("item").to_numpy(), table.column("score").to_numpy()
            full = np.bincount(item, minlength=m.items) >= top
            last = np.searchsorted(item, np.arange(m.items), "right") - 1
            least[full] = score[last[full]]
            return table

        for batch in batches:
            ids, n = batch.column("id"), batch.column("n").to_numpy()
            lists, counts = batch.column("terms"), batch.column("counts")
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), np.diff(bounds))
            size = scale(n, m.documents, m.length)
            value = m.weights[term] * (10**9 * tf // (1000 * tf + 8 * size[doc]))
            for lo in range(0, len(n), width):
                hi = min(len(n), lo + width)
                a, b = bounds[lo], bounds[hi]
                scores = accumulate(m.plan, terms, term[a:b], doc[a:b] - lo, value[a:b], hi - lo)
                item, at = np.nonzero(scores >= least[:, None])
                if len(item):
                    waiting.append(pa.table({"item": pa.array(item, pa.int32()), "score": scores[item, at], "id": ids.take(pa.array(at + lo))}))
                    rows += len(item)
                if rows > 4 * top * m.items + (1 << 14):
                    kept, waiting, rows = settle(), [], 0
        if waiting:
            kept, waiting = settle(), []
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10, block_bytes: int = 1 << 18) -> DataFrame:
    """item id, rank (from 1), document id, score: the `top` documents with a score above 0 of every item."""
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col)
    marks = pick(items, item=item_col, text=item_text_col)
    kind, of = rows.schema["id"].dataType.simpleString(), marks.schema["item"].dataType
    out, total = None, None
    for part in blocks_of(marks, "item", "text", block_bytes):
        block = items_of([tuple(r) for r in part.collect()])
        if not block.ids:
            continue
        held = spark.sparkContext.broadcast(block)
        found = checkpoint(postings(rows, held))
        held.unpersist()
        total = total or found.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(block.one), np.int64)
        for t, k in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the block has terms
            df[t] = k
        plan = share(block.terms, block.starts, len(block.one))
        model = spark.sparkContext.broadcast(Model(plan, weights(total[0], df), total[0], total[1] or 0, len(block.ids)))
        scored = found.mapInArrow(_scoring(model, top), f"item int, score long, id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, name {of.simpleString()}")
        named = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"item {of.simpleString()}, rank int, id {kind}, score long").toDF(item_col, "rank", id_col, "score")
    return out
