"""Style vectors, chunked metrics, lint, gates and genre profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

METRICS = ("avg_sent_len", "dialog_rate", "xuci_rate", "type_token")
# Scales of the style distance, dialogue marks.
SCALES = {"avg_sent_len": 30.0, "dialog_rate": 0.03, "xuci_rate": 0.06, "type_token": 0.1}
DIALOGUE = "：「\""


def style_vector(text: Column | str, function_chars: str, char_class: str = tx.HAN, ends: str = tx.SENTENCE_ENDS, dialogue: str = DIALOGUE, phrase: str | None = None) -> Column:
    """struct(chars, the four metrics, four_char): null if the text has no character of the class.

    A sentence is a part between end marks that is not blank; rates are per character of the class; `four_char` counts
    four characters before a pause mark.
    """
    text = F.col(text) if isinstance(text, str) else text
    phrase = phrase or rf"[{char_class}]{{4}}(?=[，。、；])"

    def measure(x: Column) -> Column:
        z, sents = x["z"], x["sents"]
        n = F.length(z)
        total = F.aggregate(sents, F.lit(0), lambda a, s: a + F.length(s))
        marks = F.length(x["text"]) - F.length(F.translate(x["text"], dialogue, ""))
        inside = n - F.length(F.translate(z, function_chars, "")) if function_chars else F.lit(0)
        kinds = F.size(F.array_distinct(F.filter(F.split(z, ""), lambda c: c != "")))
        return F.when(
            n > 0,
            F.struct(
                n.cast("long").alias("chars"),
                (total / F.greatest(F.size(sents), F.lit(1))).alias("avg_sent_len"),
                (marks / n).alias("dialog_rate"),
                (inside / n).alias("xuci_rate"),
                (kinds / n).alias("type_token"),
                F.regexp_count(x["text"], F.lit(phrase)).cast("long").alias("four_char"),
            ),
        )

    # The text, its characters of the class and its sentences are bound once; each is used several times.
    once = F.array(F.struct(text.alias("text"), tx.keep_chars(text, char_class).alias("z"), tx.split_sentences(text, ends).alias("sents")))
    return F.get(F.transform(once, measure), F.lit(0))


def top_chars(texts: DataFrame, keys: Sequence[str], text: str, char_class: str, k: int = 20) -> DataFrame:
    """keys, rank, char, n: the most frequent characters of each text."""
    from ..operators.ordered import top_n

    chars = texts.select(*keys, F.explode(F.filter(F.split(tx.keep_chars(text, char_class), ""), lambda c: c != "")).alias("char"))
    return top_n(chars.groupBy(*keys, "char").agg(F.count("*").alias("n")), keys, [F.desc("n"), F.col("char")], k)


def chunks(text: Column | str, size: int) -> Column:
    """Consecutive parts of `size` characters."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunked_metrics(texts: DataFrame, keys: Sequence[str], text: str, size: int, least: int, **style) -> DataFrame:
    """Mean metrics over the chunks with `least` class characters or more; the whole text if no chunk has that many."""
    whole = texts.select(*keys, style_vector(text, **style).alias("w"), F.transform(chunks(text, size), lambda c: style_vector(c, **style)).alias("v"))
    kept = F.filter("v", lambda x: x["chars"] >= least)
    used = F.when(F.size(kept) > 0, kept).otherwise(F.array("w"))
    mean = lambda m: (F.aggregate(used, F.lit(0.0), lambda a, x: a + F.coalesce(x[m], F.lit(0.0))) / F.size(used)).alias(m)
    return whole.select(*keys, *[mean(m) for m in METRICS], F.size(kept).cast("long").alias("chunks"))


def style_distance(a: Mapping[str, Column], b: Mapping[str, Column], scales: Mapping[str, float] = SCALES) -> Column:
    """Root of the mean squared scaled difference; the divisor counts all metrics, also missing ones."""
    parts = [F.coalesce(F.pow((a[m] - b[m]) / s, F.lit(2)), F.lit(0.0)) for m, s in scales.items()]
    return F.sqrt(sum(parts[1:], parts[0]) / len(scales))


def baseline(metrics: DataFrame) -> DataFrame:
    """One row: the mean of each metric."""
    return metrics.agg(*[F.avg(m).alias(f"base_{m}") for m in METRICS])


def lint(texts: DataFrame, keys: Sequence[str], text: str, banned: Sequence[str], patterns: Mapping[str, str], preferred: Sequence[str]) -> DataFrame:
    """keys, modern_n, pattern_n, preferred_n and a report: the 12 most frequent banned words, then up to 6 patterns with what to write instead."""
    word = lambda w: F.struct((-tx.count_term(F.col(text), w)).alias("m"), F.lit(w).alias("w"))
    words = F.array_sort(F.filter(F.array(*[word(w) for w in dict.fromkeys(banned)]), lambda x: x["m"] < 0))
    pats = F.filter(F.array(*[F.struct(F.regexp_count(F.col(text), F.lit(p)).alias("n"), F.lit(p).alias("p"), F.lit(alt).alias("alt")) for p, alt in patterns.items()]), lambda x: x["n"] > 0)
    shown = F.transform(F.slice(words, 1, 12), lambda x: F.concat(x["w"], F.lit("×"), -x["m"]))
    forms = F.transform(F.slice(pats, 1, 6), lambda x: F.concat(F.lit("pattern "), x["p"], F.lit("×"), x["n"], F.lit(" ("), x["alt"], F.lit(")")))
    return texts.select(
        *keys,
        (-F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x["m"])).alias("modern_n"),
        F.aggregate(pats, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("pattern_n"),
        tx.lexicon_count(text, preferred).alias("preferred_n"),
        F.concat_ws("; ", F.concat(shown, forms)).alias("report"),
    )


def style_gate(vectors: DataFrame, base: DataFrame, max_distance: float = 1.0, max_modern: int = 6) -> DataFrame:
    """Adds distance, passed and advice to rows with the metrics and modern_n, held against a one-row baseline."""
    joined = vectors.crossJoin(F.broadcast(base))
    d = style_distance({m: F.col(f"base_{m}") for m in METRICS}, {m: F.col(m) for m in METRICS})
    hints = {
        "sentences are long": F.col("avg_sent_len") > 1.15 * F.col("base_avg_sent_len"),
        "little dialogue": F.col("dialog_rate") < 0.7 * F.col("base_dialog_rate"),
        "few function words": F.col("xuci_rate") < 0.9 * F.col("base_xuci_rate"),
        "modern words": F.col("modern_n") > max_modern,
    }
    advice = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in hints.items()]), lambda x: x.isNotNull())
    out = joined.withColumn("distance", d).withColumn("passed", (F.col("distance") <= max_distance) & (F.col("modern_n") <= max_modern))
    return out.withColumn("advice", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("within the baseline")))).drop(*base.columns)


def genre_profile(texts: DataFrame, keys: Sequence[str], text: str, quote: str, verse: str, markers: Mapping[str, Sequence[str]], char_class: str, ends: str, least: int = 300) -> DataFrame:
    """Per text of `least` characters or more: sentence length, quoted characters and verse pairs per 1000, type-token ratio, marker words per 1000."""
    flat = texts.select(*keys, F.replace(F.col(text), F.lit("\n"), F.lit("")).alias("__t")).filter(F.length("__t") >= least)
    n = F.length("__t")
    sents = F.filter(F.split("__t", f"[{re.escape(ends)}]+"), lambda s: F.length(F.trim(s)) > 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, s: x + F.length(s))
    z = F.filter(F.split(tx.keep_chars("__t", char_class), ""), lambda c: c != "")
    quoted = F.regexp_extract_all("__t", F.lit(quote), F.lit(1))
    return flat.select(
        *keys,
        F.size(z).cast("long").alias("n"),
        F.round(total(sents) / F.greatest(F.size(sents), F.lit(1)), 6).alias("sent"),
        F.round(total(quoted) * 1000.0 / n, 6).alias("quote"),
        F.round(F.regexp_count("__t", F.lit(verse)) * 1000.0 / n, 6).alias("verse"),
        F.round(F.size(F.array_distinct(z)) / F.greatest(F.size(z), F.lit(1)), 6).alias("ttr"),
        *[F.round(tx.lexicon_count("__t", ws) * 1000.0 / n, 6).alias(k) for k, ws in markers.items()],
    )
