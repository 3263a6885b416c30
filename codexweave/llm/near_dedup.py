"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of `shingle` words (5); a text with fewer words, but not none, is one shingle.  The weight
of a shingle is its count in the text times 1 + idf_share * idf, where idf = ln(N / df) / ln(N), between 0 and 1.  Document
frequencies cover the whole corpus; they are counted in 2^20 hash cells, so a shingle's frequency is never
under-estimated and the table has 4 MB at any corpus size (the share of documents that a cell gets by
chance, about words per document / 2^20, does not grow with the corpus either).

1.  Texts with equal words are one class; the smallest id stands for them from here on.
2.  Sampling.  Shingles are dealt by hash to BANDS * ROWS bins.  In each bin the consistent weighted sample (r, c from
    Gamma(2, 1), beta uniform, all from the shingle's hash; t = floor(ln w / r + beta); least a = c / (y e^r))
    picks (shingle, t).  An empty bin borrows from a bin chosen by hash.  Two texts agree in a bin with about the
    probability of their weighted Jaccard similarity.
3.  Banding.  Rows of ROWS bins are hashed.  In every band bucket each text is compared with one centre, the text with the
    least id, so a bucket of any size gives one pair for each member.  Buckets of three or more whose members
    are then in different classes are settled without centres: all pairs of their texts in different classes that may reach
    `threshold` are compared.  The weighted shingles of a text are put in one order for all texts, heavy (rare) ones
    first; two texts that reach the threshold share a shingle in the part of both before less than `threshold` of the
    weight is left, and at the first they share, what is left of either is no less than the overlap they need.  So
    no pair that shares a bucket and reaches the threshold is missed, but through links that join its classes.
4.  Verification.  A pair counts if its weighted Jaccard similarity, from all shingles of both texts, is
    `threshold` or more.  Classes are the connected components of the verified pairs.

With BANDS = 40 and ROWS = 6 a pair at similarity 0.8 shares a bucket with probability 0.99999.

Defined results: null text, or text without words: a class of its own.  Null id: class_id null, no comparison.  Rows with
equal ids are one document; each is classed by its own text, and if an id stands for several texts, it is compared by the one
whose hash is least.  Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checkpoint, hold, maybe_among, measured, numbered, pick, place, salted_join, shuffle_partitions
from .components import components
from .words import mix, separator_table, slices_by_bytes, split_words, text_buffer, window_hash

_TABLE = separator_table()
CELLS = 1 << 20
SEGMENTS = 256
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Text that is sampled at once; about thirty numbers of 8 bytes are held for each of its words.
SLICE = SLICE_BYTES // 8
#: Room for rounding in bounds of weights.
SLACK = 1e-6
#: Tries to borrow a sample for an empty bin before the next filled bin is taken.
TRIES = 48


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every shingle, in order of the text, and the hash of each text's words (0: none)."""
    words = split_words(data, offsets, _TABLE)
    h = window_hash(words.hash, k)
    ok = words.doc[: len(h)] == words.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    hashes, docs = [h[ok]], [words.doc[: len(h)][ok]]
    n = np.diff(words.first)
    for size in range(1, k):  # short texts are one shingle
        few = np.flatnonzero(n == size)
        if len(few):
            hashes.append(window_hash(words.hash, size)[words.first[few]] ^ np.uint64(size))
            docs.append(few)
    hash_, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    place = np.arange(len(words.hash)) - words.first[words.doc]
    whole = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        whole[some] = np.add.reduceat(mix(words.hash + mix(place.astype(np.uint64) + np.uint64(7))), words.first[some])
    return hash_[order], doc[order], whole


def counted(hash_: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, by text."""
    order = np.lexsort((hash_, doc))
    hash_, doc = hash_[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], (hash_[1:] != hash_[:-1]) | (doc[1:] != doc[:-1])])) if len(hash_) else np.zeros(0, np.int64)
    return hash_[starts], doc[starts], np.diff(np.append(starts, len(hash_)))


def cell_of(hash_: np.ndarray) -> np.ndarray:
    return (hash_ & np.uint64(CELLS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Documents in each cell, and their number.  Each task sums up its own; segments of cells are added up apart."""
    width = CELLS // SEGMENTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dedup", _donors.cache_clear)
        total, n = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE):
                hash_, doc, _ = shingles(*text_buffer(part.column("text")), k)
                key = np.unique((doc.astype(np.int64) << 20) | cell_of(hash_))
                total += np.bincount(key & (CELLS - 1), minlength=CELLS).astype(np.uint32)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([n] + [0] * (SEGMENTS - 1), pa.int64()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(SEGMENTS)], pa.binary())], names=["segment", "n", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for segment, n, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = sums.setdefault(segment, [0, np.zeros(width, np.int64)])
                got[0] += n
                got[1] += np.frombuffer(counts, np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["segment", "n", "counts"])

    schema = "segment int, n long, counts binary"
    partial = docs.select("text").mapInArrow(count, schema)
    added = partial.repartition(min(SEGMENTS, shuffle_partitions(docs.sparkSession)), "segment").mapInArrow(add, schema)
    out, n = np.zeros(CELLS, np.int64), 0
    for r in added.collect():  # SEGMENTS rows, 8 MB at any corpus size
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
        n += r["n"]
    return out, n


def idf_weights(df: np.ndarray, n: int, idf_share: float) -> np.ndarray:
    idf = np.log((n + 1) / np.clip(df, 1, n + 1)) / np.log(n + 1) if n else np.zeros(CELLS)
    return (1 + idf_share * idf).astype(np.float32)


def _uniform(h: np.ndarray) -> np.ndarray:
    """32-bit numbers as open-interval uniforms."""
    return (h.astype(np.float64) + 0.5) / 4294967296.0


def samples(hash_: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x BINS consistent weighted samples; rows of texts without shingles are zero."""
    h1, h2, h3 = (mix(hash_ + np.uint64(s)) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B))
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    r = -np.log(_uniform(h1 & low) * _uniform(h1 >> half))
    c = -np.log(_uniform(h2 & low) * _uniform(h2 >> half))
    beta = _uniform(h3 & low)
    t = np.floor(np.log(weight) / r + beta)
    a = np.log(c) - r * (t - beta) - r
    place = doc * BINS + ((h3 >> half) % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((a, place))
    place = place[order]
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    chosen = order[first]
    picked = mix(hash_[chosen] + mix(t[chosen].astype(np.int64).astype(np.uint64)))
    out, full = np.zeros(n_docs * BINS, np.uint64), np.zeros(n_docs * BINS, bool)
    out[place[first]], full[place[first]] = picked, True
    return densify(out.reshape(n_docs, BINS), full.reshape(n_docs, BINS))


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    at = np.arange(TRIES * BINS, dtype=np.uint64).reshape(TRIES, BINS)
    return (mix(at + np.uint64(0x510E527FADE682D1)) % np.uint64(BINS)).astype(np.int64)


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = values.copy()
    row, col = np.nonzero(~full & full.any(1)[:, None])
    for donors in _donors():
        if not len(row):
            return out
        from_ = donors[col]
        ok = full[row, from_]
        out[row[ok], col[ok]] = values[row[ok], from_[ok]]
        row, col = row[~ok], col[~ok]
    if len(row):  # very few filled bins: the next one, in a circle
        at = np.where(full, np.arange(BINS), 2 * BINS)
        after = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1]
        following = np.where(after < 2 * BINS, after, at.min(1)[:, None])
        out[row, col] = values[row, following[row, col]]
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """n_docs x BANDS hashes."""
    powers = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    rows = sample.reshape(len(sample), BANDS, ROWS)
    return mix((mix(rows) * powers).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


SKETCH = "doc long, whole long, check long, bands array<long>"


def _sketching(shared: Broadcast, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dedup", _donors.cache_clear)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE):
                hash_, doc, whole = shingles(*text_buffer(part.column("text")), k)
                hash_, doc, count = counted(hash_, doc)
                keys = band_keys(samples(hash_, doc, count * shared.value[cell_of(hash_)], part.num_rows))
                some = whole != 0
                check = np.zeros(part.num_rows, np.uint64)  # a second hash of the text: of its shingles as a multiset
                np.add.at(check, doc, mix(hash_) * count.astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * BANDS, pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
                mask = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(mask), pa.array(whole[some].view(np.int64)), pa.array(check[some].view(np.int64)), lists], names=["doc", "whole", "check", "bands"])

    return run


def _features(k: int):
    """doc, hash of its words, and its shingles: sorted 32-bit hashes, repeated as often as they occur."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dedup", _donors.cache_clear)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE):
                hash_, doc, whole = shingles(*text_buffer(part.column("text")), k)
                low = (hash_ & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order = np.lexsort((low, doc))
                ends = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
                low = low[order]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(whole.view(np.int64)), pa.array([low[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc", "whole", "shingles"])

    return run


PREFIX = "doc long, total double, items array<struct<item:long,left:double>>"


def _prefixes(shared: Broadcast, k: int, threshold: float):
    """doc, its weight, and the shingles of which one is shared with each text that reaches the threshold, with the weight left from there on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near_dedup", _donors.cache_clear)
        weights = shared.value
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE):
                hash_, doc, _ = shingles(*text_buffer(part.column("text")), k)
                low, doc, count = counted(hash_ & np.uint64(0xFFFFFFFF), doc)
                of = np.repeat(np.arange(len(low)), count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                item = mix(low[of] + (nth.astype(np.uint64) << np.uint64(32)))
                doc, weight = doc[of], weights[cell_of(low[of])].astype(np.float64)
                order = np.lexsort((item, -weight, doc))
                item, doc, weight = item[order], doc[order], weight[order]
                total = np.bincount(doc, weight, part.num_rows)
                upto = np.concatenate([[0.0], np.cumsum(weight)])
                ends = np.searchsorted(doc, np.arange(part.num_rows), side="right")
                left = upto[ends][doc] - upto[:-1]
                among = left >= threshold * total[doc] * (1 - SLACK)
                sizes = np.bincount(doc[among], minlength=part.num_rows)
                pairs = pa.StructArray.from_arrays([pa.array(item[among].view(np.int64)), pa.array(left[among])], ["item", "left"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(total), lists], names=["doc", "total", "items"])

    return run


def rest_pairs(members: DataFrame, labels: DataFrame, docs: DataFrame, shared: Broadcast, k: int, threshold: float) -> tuple[DataFrame, int] | None:
    """Pairs (a, b) of different classes, among them all that reach the threshold in buckets of three or more; None if no bucket is mixed.

    Classes meet first, by their bounds for a shingle; only of classes that may hold a pair are the texts joined.
    """
    many = members.filter("n > 2").select("key", "doc")
    here = many.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    mixed = here.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    open_, seen = measured(here.join(mixed, "key").select("doc", "label").distinct(), n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    texts = maybe_among(docs, "doc", open_.select("doc"), seen["n"]).filter("__among").select("doc", "text")
    prefixes = checkpoint(texts.mapInArrow(_prefixes(shared, k, threshold), PREFIX).join(open_, "doc"))
    rows = prefixes.select("doc", "label", "total", F.explode("items").alias("x")).select("doc", "label", "total", "x.item", "x.left")
    of_class = rows.groupBy("item", "label").agg(F.max("left").alias("left"), F.min("total").alias("total"))
    enough = lambda l, m, t, u: F.least(l, m) >= (F.col(t) + F.col(u)) * (threshold / (1 + threshold) * (1 - SLACK))

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("item", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "item"])

    fits = (F.col("label_x") < F.col("label_y")) & enough("left_x", "left_y", "total_x", "total_y")
    met = side(of_class, "x").join(side(of_class, "y"), "item").filter(fits).select("item", "label_x", "label_y")
    each = met.join(side(rows, "x"), ["item", "label_x"]).join(side(rows, "y"), ["item", "label_y"]).filter(fits)
    pairs, seen = measured(each.select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct(), n=F.count(F.lit(1)))
    return pairs, seen["n"]


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Of two sorted arrays of 32-bit shingle hashes, repeated as often as they occur."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = float((np.minimum(n[i], m[j]) * weights[both & (CELLS - 1)]).sum())
    total = float((n * weights[x & (CELLS - 1)]).sum() + (m * weights[y & (CELLS - 1)]).sum()) - shared
    return shared / total if total else 0.0


def _verifying(shared: Broadcast, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            got = [weighted_jaccard(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32), weights) for a, b in zip(batch.column("fa"), batch.column("fb"))]
            mask = pa.array([g >= threshold for g in got])
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(got, pa.float64()).filter(mask)], names=["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, n_pairs: int, docs: DataFrame, shared: Broadcast, k: int, threshold: float) -> tuple[DataFrame, int]:
    """The pairs (a, b) of ids whose texts reach the threshold, and their number.  Only texts in pairs are shuffled; pairs of a hot text are dealt to several tasks."""
    ids, seen = measured(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), n=F.count(F.lit(1)))
    texts = maybe_among(docs, "doc", ids, seen["n"]).filter("__among").select("doc", "text")
    found = texts.mapInArrow(_features(k), "doc long, whole long, shingles binary")
    features = checkpoint(found.groupBy("doc").agg(F.min(F.struct("whole", "shingles")).alias("m")).select("doc", F.col("m.shingles").alias("shingles")))
    both = pairs
    for end in ("a", "b"):
        counts = pairs.groupBy(end).agg(F.count("*").alias("n"))
        both = salted_join(both, features.select(F.col("doc").alias(end), F.col("shingles").alias(f"f{end}")), [end], n_pairs, counts=counts, salt=["a", "b"])
    links, seen = measured(both.select("a", "b", "fa", "fb").mapInArrow(_verifying(shared, threshold), "a long, b long, similarity double"), n=F.count(F.lit(1)))
    return links, seen["n"]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, idf_share: float = 0.3) -> DataFrame:
    """id, class_id (the least id of the class), n_links (verified links of its text to different texts), one row for each document."""
    rows = pick(docs, doc=id_col, text=text_col).select(F.col("doc").cast("long").alias("doc"), "text")
    named = rows.filter("doc is not null and text is not null")
    df, n = document_frequencies(named, shingle)
    shared = docs.sparkSession.sparkContext.broadcast(idf_weights(df, n, idf_share))  # 4 MB at any corpus size
    sketch = checkpoint(named.mapInArrow(_sketching(shared, shingle), SKETCH))
    whole = ["whole", "check"]
    texts = checkpoint(sketch.groupBy(*whole).agg(F.min(F.struct("doc", "bands")).alias("m"), F.count("*").alias("n")).select(*whole, "m.doc", "m.bands", "n"))
    spread = texts.select("doc", F.explode("bands").alias("key"))
    centres = checkpoint(spread.groupBy("key").agg(F.min("doc").alias("centre"), F.count("*").alias("n")).filter("n > 1"))
    members = checkpoint(salted_join(spread, centres, ["key"], n * BANDS, counts=centres.select("key", "n")))
    nothing = docs.sparkSession.range(0).toDF("node")  # a list would start Python workers of another kind
    pairs, seen = measured(members.filter("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct(), n=F.count(F.lit(1)))
    links, n_links = verified(pairs, seen["n"], named, shared, shingle, threshold) if seen["n"] else (None, 0)
    labels = components(links) if n_links else nothing.select("node", F.col("node").alias("label"))
    rest = rest_pairs(members, labels, named, shared, shingle, threshold)
    if rest is not None and rest[1]:
        new, n_new = verified(*rest, named, shared, shingle, threshold)
        if n_new:
            links = new if links is None else links.unionByName(new)
            labels = components(links)
    if links is None:
        degree = nothing.select("node", F.col("node").alias("n_links"))
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_text = texts.select(*whole, F.col("doc").alias("node")).join(labels, "node", "left").join(degree, "node", "left")
    of_text = of_text.select(*whole, F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classed = salted_join(sketch.select("doc", *whole), of_text, whole, n, counts=texts.select(*whole, "n"), salt=["doc"]).select("doc", "class_id", "n_links")
    rest = rows.select("doc", F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("words")).filter("doc is null or not words").select("doc", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return classed.unionByName(rest).withColumnRenamed("doc", id_col)


def keep_one(docs: DataFrame, classed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose class has a smaller id; of rows equal in id and text one stays.

    Rows with null id stay, but for repeats.  Rows with one id and different texts go only if the classes of all their texts have a smaller
    id.  Documents that surely stay as they are, mostly, are not shuffled.
    """
    ids = pick(classed, key=id_col, class_id="class_id").select(F.col("key").cast("long").alias("key"), "class_id").filter("key is not null")
    fate = ids.groupBy("key").agg(F.count("*").alias("n"), F.every(F.col("key") != F.col("class_id")).alias("gone")).filter("gone or n > 1")
    fate, seen = measured(fate.select(F.col("key").alias("__fate"), F.col("gone").alias("__gone")), n=F.count(F.lit(1)))
    rows = numbered(docs)
    flagged = maybe_among(rows.withColumn("__key", place(docs, id_col).cast("long")), "__key", fate, seen["n"])
    stay = flagged.filter(~F.col("__among")).select(*rows.columns)
    unsure = flagged.filter("__among").join(fate.filter("__gone"), F.col("__key") == F.col("__fate"), "left_anti")
    once = unsure.withColumns({"__id": place(docs, id_col), "__text": place(docs, text_col)}).dropDuplicates(["__id", "__text"])
    return stay.unionByName(once.select(*rows.columns)).toDF(*docs.columns)
