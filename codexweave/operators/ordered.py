"""Order-dependent operators that do not put a whole group into one task.

The order column is an integer.  It is cut into blocks of `block` values; the work is done inside (group, block), and
what has to cross blocks (a count, a sum, a last value, a few neighbouring rows) is carried by a table with a row
per block or by copies of the rows near a block's edge.  No row is lost: a null group is a group like others, and rows with a null
order come first in theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _cut(df: DataFrame, group: Sequence[str], order: str, block: int) -> DataFrame:
    """Adds the block, and group and block as one key; structs are equal where their nulls are, so that joins keep these rows."""
    cut = df.withColumn("__b", F.floor(F.col(order) / block))
    return cut.withColumn("__g", F.struct(*group, "__b"))


def running_sum(df: DataFrame, group: Sequence[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Sum of `value` up to and with each row; rows of equal order count in any sequence but must be unique for a stable result."""
    cut = _cut(df.withColumn("__v", value), group, order, block)
    before = Window.partitionBy(*[F.col("__g")[c] for c in group]).orderBy(F.col("__g")["__b"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("__g").agg(F.sum("__v").alias("__s")).select("__g", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__c"))
    inside = F.sum("__v").over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("__i", inside).join(carried, "__g")
    return out.withColumn(name, F.col("__i") + F.col("__c")).drop("__b", "__g", "__v", "__i", "__c")


def fill_forward(df: DataFrame, group: Sequence[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """The last value that is not null, up to and with each row."""
    cut = _cut(df, group, order, block)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value)))
    last = cut.groupBy("__g").agg(F.max(known)[value].alias("__l"))
    before = Window.partitionBy(*[F.col("__g")[c] for c in group]).orderBy(F.col("__g")["__b"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__g", F.last("__l", ignorenulls=True).over(before).alias("__c"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__i", inside).join(carried, "__g").withColumn(name, F.coalesce("__i", "__c")).drop("__b", "__g", "__i", "__c")


def neighbourhood(df: DataFrame, group: Sequence[str], order: str, halo: int, columns: Callable[[Window], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """Window columns that look at most `halo` rows back and ahead, for an order column without gaps.

    Rows within `halo` of a block's edge are copied into the neighbouring block and dropped afterwards.
    """
    cut = _cut(df, [], order, block).drop("__g")
    place = F.col(order) - F.col("__b") * block
    homes = F.array(F.lit(0), F.when(place < halo, -1), F.when(place >= block - halo, 1))
    spread = cut.withColumn("__d", F.explode(F.filter(homes, lambda x: x.isNotNull()))).withColumn("__b", F.col("__b") + F.col("__d"))
    w = Window.partitionBy(*group, "__b").orderBy(order)
    return spread.withColumns(columns(w)).filter("__d = 0").drop("__b", "__d")


def smooth(df: DataFrame, group: Sequence[str], order: str, value: str, name: str, radius: int = 2) -> DataFrame:
    """Centred moving mean, clipped at the ends."""
    return neighbourhood(df, group, order, radius, lambda w: {name: F.avg(value).over(w.rowsBetween(-radius, radius))})


def turning_points(df: DataFrame, group: Sequence[str], order: str, value: str, k: int = 6, apart: int = 6, radius: int = 2) -> DataFrame:
    """Steepest falls: d = v[i + radius] - v[i - radius]; the k lowest of a group, then one near a better one goes.

    As in the original, thinning follows the choice of k, so fewer than k may remain.
    """
    d = neighbourhood(df, group, order, radius, lambda w: {"d": F.lead(value, radius).over(w) - F.lag(value, radius).over(w)}).filter("d is not null")
    low = d.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy("d", order))).filter(F.col("__k") <= k)
    ranked = low.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), F.col(order).alias("at"), F.col("d").alias("d")))).alias("__r"))

    def thin(kept: Column, x: Column) -> Column:
        close = F.exists(kept, lambda y: F.abs(y["at"] - x["at"]) <= apart)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("__r", F.slice("__r", 1, 0), thin)
    return ranked.select(*group, F.explode(kept).alias("__x")).select(*group, F.col("__x.at").alias(order), F.col("__x.d").alias("d"))


def islands(df: DataFrame, group: Sequence[str], order: str, gap: int) -> DataFrame:
    """Adds `island`: a number that rises where the distance to the row before is more than `gap`.  Unique order per group."""
    ranked = running_sum(df, group, order, F.lit(1), "__rank")
    marked = neighbourhood(ranked, group, "__rank", 1, lambda w: {"__gap": F.col(order) - F.lag(order, 1).over(w)})
    return running_sum(marked, group, order, F.when(F.col("__gap") > gap, 1).otherwise(0), "island").drop("__rank", "__gap")


def fold_id(chapter: Column | str, size: Column | str, k: int) -> Column:
    """Contiguous folds of ceil(size / k) chapters, from 0; chapter counts from 1."""
    chapter, size = (F.col(c) if isinstance(c, str) else c for c in (chapter, size))
    return F.floor((chapter - 1) / F.ceil(size / k)).cast("int")


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; Spark limits each task's part of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def assign_chapters(blocks: DataFrame, group: Sequence[str], order: str, number: str, title: str | None = None) -> DataFrame:
    """Chapter of each block: headings (non-null `number`) in reading order start one if their number rises; a heading not above the highest
    before it, and so a repeated one, is ignored; blocks before the first are chapter 0.  `title` names a text column: the chapter's title is that of its heading."""
    ranked = running_sum(blocks, group, order, F.lit(1), "__r")
    highest = fill_forward(ranked.withColumn("__n", F.col(number)), group, order, "__n", "__last")
    best = _running_max(highest, group, order, F.col("__n"), "__max")
    rising = neighbourhood(best, group, "__r", 1, lambda w: {"__m": F.lag("__max", 1).over(w)})
    start = F.when(F.col("__n").isNotNull() & (F.col("__n") > F.coalesce("__m", F.lit(0))), F.col("__n"))
    out = fill_forward(rising.withColumn("__start", start), group, order, "__start", "__found")
    if title is not None:
        out = fill_forward(out.withColumn("__t", F.when(F.col("__start").isNotNull(), F.coalesce(title, F.lit("")))), group, order, "__t", "chapter_title").drop("__t")
    return out.withColumn("chapter", F.coalesce("__found", F.lit(0)).cast("int")).drop("__r", "__n", "__last", "__max", "__m", "__start", "__found")


def _running_max(df: DataFrame, group: Sequence[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    cut = _cut(df.withColumn("__v", value), group, order, block)
    before = Window.partitionBy(*[F.col("__g")[c] for c in group]).orderBy(F.col("__g")["__b"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("__g").agg(F.max("__v").alias("__s")).select("__g", F.max("__s").over(before).alias("__c"))
    inside = F.max("__v").over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__i", inside).join(carried, "__g").withColumn(name, F.greatest("__i", "__c")).drop("__b", "__g", "__v", "__i", "__c")
