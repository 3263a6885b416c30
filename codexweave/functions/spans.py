"""Match positions with Spark's own functions.

Spark gives the matches of a pattern (`regexp_extract_all`) and the pieces between them (`split`), but no
positions.  Both walk the same leftmost, non-overlapping matches, so running sums of the lengths give each
match its place in code points.  Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,left:string>"


def with_spans(df: DataFrame, text_col: str, patterns: dict[str, str], left_chars: int = 0) -> DataFrame:
    """Adds, for each kind, an array of (start, end, value, left) in order; `left` is the text before the match, left_chars code points at most.

    The text is split only where there are matches.  A null text has none.
    """
    df = df.withColumns({f"__m_{k}": F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    out = df.withColumns({k: _spans(F.col(text_col), F.col(f"__m_{k}"), F.split(F.col(text_col), p, -1), left_chars) for k, p in patterns.items()})
    return out.drop(*(f"__m_{k}" for k in patterns))


def term_spans(df: DataFrame, text_col: str, term_col: str, name: str) -> DataFrame:
    """Adds the spans of the row's own term in its text."""
    quoted = F.concat(F.lit(r"\Q"), F.col(term_col), F.lit(r"\E"))
    df = df.withColumn("__m", F.regexp_extract_all(F.col(text_col), quoted, F.lit(0)))
    return df.withColumn(name, _spans(F.col(text_col), F.col("__m"), F.split(F.col(text_col), quoted, F.lit(-1)), 0)).drop("__m")


def _spans(text: Column, matches: Column, pieces: Column, left_chars: int) -> Column:
    empty = F.array().cast(f"array<{SPAN}>")
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))

    last = lambda *parts: F.right(F.concat(*parts), F.lit(left_chars)) if left_chars else F.lit("")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        left = last(acc["tail"], x["piece"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value"), left.alias("left"))
        return F.struct(end.alias("at"), last(left, x["match"]).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, first, step, lambda a: a["out"])).otherwise(empty)


def render(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas, in the order of the array."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))
