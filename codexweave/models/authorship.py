"""Authorship statistics: Burrows Delta, keyness, shifts of names, climate curves, verdicts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import top_n
from ..operators.store import checkpoint


def feature_rates(texts: DataFrame, keys: Sequence[str], text: str, features: Sequence[str]) -> DataFrame:
    """keys, feature, rate per 1000 characters, long form.  A projection; no shuffle."""
    n = F.greatest(F.length(text), F.lit(1))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), (tx.count_term(F.col(text), f) * 1000.0 / n).alias("rate")) for f in dict.fromkeys(features)])
    return texts.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.feature", "x.rate")


def scales_of(rates: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation (0 counts as 1) of each feature."""
    sd = F.stddev_pop("rate")
    return rates.groupBy(*group, "feature").agg(F.avg("rate").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def burrows_delta(rates: DataFrame, chapter: str, split: int, group: Sequence[str] = (), scales: DataFrame | None = None, centroids: DataFrame | None = None, zero_when_empty: bool = False) -> DataFrame:
    """group, chapter, dh, dt, d = dt - dh: mean absolute distance of z-scores to the centroids of the head (chapter <= split) and the tail.

    A chapter is left out of its own centroid by subtraction, so the work is linear.  A side without other chapters has no
    centroid: its distance is null unless `zero_when_empty`.  `scales` may come from another stream, `centroids` (feature,
    head, tail) from elsewhere.
    """
    on = [*group, "feature"]
    z = rates.join(scales if scales is not None else scales_of(rates, group), on if scales is None else "feature")
    z = z.select(*group, chapter, "feature", ((F.col("rate") - F.col("mean")) / F.col("sd")).alias("z"), (F.col(chapter) <= split).alias("is_head"))
    if centroids is None:
        sums = z.groupBy(*on).agg(F.sum(F.when(F.col("is_head"), F.col("z")).otherwise(0.0)).alias("sh"), F.sum(F.when(~F.col("is_head"), F.col("z")).otherwise(0.0)).alias("st"), F.count(F.when(F.col("is_head"), 1)).alias("nh"), F.count(F.when(~F.col("is_head"), 1)).alias("nt"))
        j = z.join(sums, on)
        own = lambda flag: F.when(flag, F.col("z")).otherwise(0.0)
        nh, nt = F.col("nh") - F.when(F.col("is_head"), 1).otherwise(0), F.col("nt") - F.when(F.col("is_head"), 0).otherwise(1)
        empty = F.lit(0.0) if zero_when_empty else F.lit(None).cast("double")
        head = F.when(nh > 0, (F.col("sh") - own(F.col("is_head"))) / nh).otherwise(empty)
        tail = F.when(nt > 0, (F.col("st") - own(~F.col("is_head"))) / nt).otherwise(empty)
    else:
        j, head, tail = z.join(centroids, "feature"), F.col("head"), F.col("tail")
    out = j.groupBy(*group, chapter).agg(F.avg(F.abs(F.col("z") - head)).alias("dh"), F.avg(F.abs(F.col("z") - tail)).alias("dt"))
    return out.withColumn("d", F.col("dt") - F.col("dh"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's G2 of two counts out of two totals."""
    p = (k1 + k2) / (n1 + n2)
    expected = _xlogx(n1 * p) + _xlogx(n2 * p) + _xlogx(n1 - n1 * p) + _xlogx(n2 - n2 * p)
    return -2 * (expected - (_xlogx(k1 * 1.0) + _xlogx(k2 * 1.0) + _xlogx((n1 - k1) * 1.0) + _xlogx((n2 - k2) * 1.0)))


def keyness(texts: DataFrame, text: str, is_head: Column, char_class: str, least: int = 60, ratio: float = 1.5, k: int = 26) -> DataFrame:
    """side, w, h, t, g, r: characters whose rates differ by `ratio` or more between head and tail, the k highest G2 of each side."""
    chars = texts.select(is_head.alias("head"), F.explode(F.filter(F.split(tx.keep_chars(text, char_class), ""), lambda c: c != "")).alias("w"))
    n = chars.groupBy("w").agg(F.count(F.when(F.col("head"), 1)).alias("h"), F.count(F.when(~F.col("head"), 1)).alias("t"))
    sizes = n.agg(F.sum("h").alias("nh"), F.sum("t").alias("nt"))
    r = F.coalesce(F.try_divide("h", "nh"), F.lit(0.0)) / F.greatest(F.coalesce(F.try_divide("t", "nt"), F.lit(0.0)), F.lit(1e-9))
    scored = n.filter(F.col("h") + F.col("t") >= least).crossJoin(F.broadcast(sizes)).select("w", "h", "t", log_likelihood(F.col("h"), F.col("nh"), F.col("t"), F.col("nt")).alias("g"), r.alias("r"))
    side = F.when(F.col("r") >= ratio, "front").when(F.col("r") <= 0.667, "back")
    return top_n(scored.withColumn("side", side).filter("side is not null"), ["side"], [F.desc("g"), F.col("w")], k).drop("rank")


def exclusive_terms(texts: DataFrame, text: str, is_head: Column, char_class: str, least: int = 12, k: int = 40) -> DataFrame:
    """side, w, n: characters with `least` occurrences on one side and none on the other."""
    chars = texts.select(is_head.alias("head"), F.explode(F.filter(F.split(tx.keep_chars(text, char_class), ""), lambda c: c != "")).alias("w"))
    n = chars.groupBy("w").agg(F.count(F.when(F.col("head"), 1)).alias("h"), F.count(F.when(~F.col("head"), 1)).alias("t"))
    one = n.filter("h = 0 or t = 0").select("w", F.when(F.col("t") == 0, "head").otherwise("tail").alias("side"), F.greatest("h", "t").alias("n"))
    return top_n(one.filter(F.col("n") >= least), ["side"], [F.desc("n"), F.col("w")], k).drop("rank")


def name_shift(texts: DataFrame, text: str, is_head: Column, names: Sequence[str], char_class: str, least: int = 8) -> DataFrame:
    """name, h, t, rates per 10,000 class characters, ratio."""
    cells = F.array(*[F.struct(F.lit(w).alias("name"), tx.count_term(F.col(text), w).alias("n")) for w in names])
    each = texts.select(is_head.alias("head"), F.length(tx.keep_chars(text, char_class)).alias("size"), cells.alias("x"))
    sizes = each.agg(F.sum(F.when(F.col("head"), F.col("size"))).alias("nh"), F.sum(F.when(~F.col("head"), F.col("size"))).alias("nt"))
    n = each.select("head", F.explode("x").alias("x")).groupBy("x.name").agg(F.sum(F.when(F.col("head"), F.col("x.n")).otherwise(0)).alias("h"), F.sum(F.when(~F.col("head"), F.col("x.n")).otherwise(0)).alias("t"))
    rate = lambda k, s: k * 10000.0 / F.greatest(F.coalesce(s, F.lit(0)), F.lit(1))
    both = n.filter(F.col("h") + F.col("t") >= least).crossJoin(F.broadcast(sizes)).withColumn("rh", rate(F.col("h"), F.col("nh"))).withColumn("rt", rate(F.col("t"), F.col("nt")))
    return both.select("name", "h", "t", "rh", "rt", (F.col("rt") / F.greatest("rh", F.lit(1e-6))).alias("ratio"))


def climate_curve(texts: DataFrame, keys: Sequence[str], text: str, lexicons: Mapping[str, Sequence[str]]) -> DataFrame:
    """Densities per 1000 of each lexicon, tint = (warm - cool) / max(1, warm + cool), gloom = (tear + death + void) / max(1, laugh + joy), from counts.

    Lexicons named warm, cool, tear, death, void, laugh and joy are expected.
    """
    n = {k: tx.lexicon_count(text, ws) for k, ws in lexicons.items()}
    counted = texts.select(*keys, F.length(text).alias("__n"), *[c.alias(f"__{k}") for k, c in n.items()])
    c = lambda k: F.col(f"__{k}")
    dens = [F.round(F.when(F.col("__n") > 0, c(k) * 1000.0 / F.col("__n")).otherwise(0.0), 6).alias(k) for k in lexicons]
    tint = (c("warm") - c("cool")) / F.greatest(c("warm") + c("cool"), F.lit(1))
    gloom = (c("tear") + c("death") + c("void")) / F.greatest(c("laugh") + c("joy"), F.lit(1))
    return counted.select(*keys, *dens, F.round(tint, 6).alias("tint"), F.round(gloom, 6).alias("gloom"))


def _closest(k: int):
    """The k rows of a cell that are nearest to each of its queries."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = [c for c in rows.column_names if c.startswith("x")]
        keys, near = queries.column("key").to_numpy(), rows.column("near").to_numpy()
        points, values = (np.stack([t.column(c).to_numpy() for c in names], 1).reshape(len(t), len(names)) for t in (queries, rows))
        best_d, best_n = np.full((len(keys), k), np.inf), np.zeros((len(keys), k), np.int64)
        step = max(1, (1 << 22) // max(1, len(keys)))
        for i in range(0, len(near) if len(keys) else 0, step):
            part = values[i : i + step]
            d = np.round(np.sqrt(sum((points[:, j, None] - part[None, :, j]) ** 2 for j in range(len(names))) / len(names)), 9)
            d, n = np.concatenate([best_d, d], 1), np.concatenate([best_n, np.broadcast_to(near[i : i + step], (len(keys), len(part)))], 1)
            order = np.lexsort((n, d))[:, :k]
            best_d, best_n = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
        row, col = np.nonzero(np.isfinite(best_d))
        return pa.table({"key": keys[row], "near": best_n[row, col], "distance": best_d[row, col]})

    return run


def nearest_of_all(queries: DataFrame, rows: DataFrame, key: str, near_key: str, features: Sequence[str], scales: DataFrame, k: int = 3, cell_rows: int = 20_000, most_cells: int = 4096) -> DataFrame:
    """key, near_key, distance, rank: of all rows the k nearest to each query, by root mean square of differences of features.

    Features are divided by those of `scales` (one row, 0 counts as 1).  Rows are cut into cells by the scaled feature that varies most, at quantiles; a cell with more
    rows than `cell_rows` is dealt to several tasks.  A query first meets its own cell, which bounds the distance of its k-th neighbour, and then only
    cells that this bound reaches, since rows differ by at least the difference in one feature.  Queries and rows are tables throughout.  Distances tie at nine
    digits, then the smaller key comes first.  Keys are integers; rows with a null feature are none.
    """
    one = scales.select(*[F.col(f).cast("double") for f in features]).first()
    scale = [1.0 if x is None or x == 0 else x for x in one]
    xs = [(F.col(f).cast("double") / F.lit(s)).alias(f"x{i}") for i, (f, s) in enumerate(zip(features, scale))]
    found = checkpoint(rows.select(F.col(near_key).cast("long").alias("near"), *xs).dropna())
    asked = checkpoint(queries.select(F.col(key).cast("long").alias("key"), *xs).dropna())
    size, *spread = found.agg(F.count("*"), *[F.stddev_pop(f"x{i}") for i in range(len(scale))]).first()
    axis = f"x{int(np.argmax([x or 0.0 for x in spread]))}"
    cells = min(most_cells, max(1, -(-size // cell_rows)))
    cuts = found.agg(F.percentile_approx(axis, [i / cells for i in range(1, cells)], 10_000)).first()[0] if cells > 1 and size else []
    cuts = sorted(set(cuts))

    def in_cells(df: DataFrame, *at: str) -> DataFrame:
        """df with the cell of each position."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [pa.array(np.searchsorted(cuts, batch.column(a).to_numpy(zero_copy_only=False), "right").astype(np.int32)) for a in at]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f"cell_{a}" for a in at]])

        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"cell_{a} int" for a in at]
        return df.mapInArrow(run, ", ".join(kinds))

    placed = checkpoint(in_cells(found, axis).withColumnRenamed(f"cell_{axis}", "cell"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))  # most_cells rows at most
    dealt = checkpoint(placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("near"), F.col("parts")).cast("int")).drop("parts"))

    def meet(some: DataFrame) -> DataFrame:
        """Queries with the cells that they go to -> their k nearest rows of each part of these cells."""
        sent = some.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return sent.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInArrow(lambda q, r: _closest(k)(q, r), "key long, near long, distance double")

    order = [F.col("distance"), F.col("near")]
    mine = in_cells(asked, axis).withColumnRenamed(f"cell_{axis}", "cell")
    first = checkpoint(top_n(meet(mine), ["key"], order, k))
    bound = first.filter(F.col("rank") == k).select("key", (F.col("distance") + 1e-8).alias("bound"))
    reach = F.coalesce("bound", F.lit(float("inf"))) * math.sqrt(len(scale))
    wide = mine.withColumnRenamed("cell", "own").join(bound, "key", "left").withColumns({"lo": F.col(axis) - reach, "hi": F.col(axis) + reach}).drop("bound")
    others = in_cells(wide, "lo", "hi").withColumn("cell", F.explode(F.sequence("cell_lo", "cell_hi"))).filter("cell <> own").select("key", *[f"x{i}" for i in range(len(scale))], "cell")
    every = first.select("key", "near", "distance").unionByName(meet(others))
    return top_n(every, ["key"], order, k).select(F.col("key").alias(key), F.col("near").alias(near_key), "distance", "rank")


def verdict(length: Column, distance: Column, ppl: Column, inside: Column, outside: Column) -> Column:
    """Band of a text from its style distance and its perplexity against in-sample and held-out medians."""
    style = F.when(distance <= 1, "close").when(distance <= 2, "near").otherwise("far")
    words = F.when(ppl <= inside * 1.05, "in corpus").when(ppl <= outside * 1.15, "like corpus").when(ppl <= outside * 1.6, "imitation").otherwise("other")
    note = F.when(length < 600, " (short)").otherwise("")
    return F.when(length < 200, "too short").otherwise(F.concat(style, F.lit(", "), words, note))
