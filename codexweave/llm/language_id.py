"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of sample texts.  A text is cut into
blocks of `block_bytes`, lower-cased; each block is compressed with every language's dictionary, and the language
with the smallest sum of sizes wins.  Blocks are compressed apart from each other so that a long
text keeps being measured against the dictionaries and not against itself; all blocks of
the whole text count.

The score is the margin (second - best) / second, between 0 and 1.  `rejected` is true if there
is no verdict or the score is below `min_margin`.

Bounded training sample (the documented bound): of each language the `docs_per_lang` training
documents with the lowest hash of the id, of these at most `dict_bytes` bytes altogether.  Each of them has the same
share of these bytes: a text with more gives SLICES pieces, one from each part of the whole text, at places chosen by hash.  Of rows with
equal id and language the least text counts.  Every language that is
named in a training row is learned; more than GROUP of them are scored in groups, so that a task holds one group's compressors
at a time.  Only text and language of training rows are used.

Defined results: null text, or text without a letter: `und`, score 0, rejected.  No training rows:
every row is `und`.  Ties: the language with more training rows wins, of these the first by name, with score 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, hold, numbered, pick, place
from .words import slices_by_bytes

#: Languages whose compressors a task holds at once.
GROUP = 64
#: Pieces that a long training text gives.
SLICES = 4


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 256, dict_bytes: int = 1 << 17) -> dict[str, bytes]:
    """Dictionary content of every language, the most frequent first, from a bounded sample of the labelled rows."""
    labelled = pick(rows, id=id_col, text=text_col, lang=lang_col).select("id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return {}
    langs = list(counts)
    # Only ids and languages are ranked, and of each language only about four times the wanted number, by hash.
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    bound = [min(1 << 30, (4 * docs_per_lang << 30) // n) for n in counts.values()]
    bounds = labelled.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "bound": pa.array(bound, pa.int64())}))  # a list would start Python workers of another kind
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(spot, "id"))
    few = labelled.select("id", "lang").join(F.broadcast(bounds), "lang").filter(spot <= F.col("bound")).select("id", "lang").distinct()
    chosen = few.withColumn("k", rank).filter(F.col("k") <= docs_per_lang).select("id", "lang", "k")
    picked = chosen.distinct().limit(docs_per_lang * len(langs))  # a proven bound for the broadcast
    share = max(64, dict_bytes // docs_per_lang)
    sample = labelled.join(F.broadcast(picked), ["id", "lang"]).select("lang", "k", pieces(F.col("text"), F.col("id"), share).alias("text")).groupBy("lang", "k").agg(F.min("text").alias("text"))
    content: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["k"], r["text"])):
        content.setdefault(r["lang"], []).append(cut(r["text"].lower(), share - 1))
    return {lang: b"\n".join(content[lang]) for lang in langs if lang in content}


def cut(text: str, size: int) -> bytes:
    """The text in UTF-8, up to the last code point that ends within `size` bytes."""
    raw = text.encode()
    return raw if len(raw) <= size else raw[:size].decode(errors="ignore").encode()


def pieces(text: Column, id_: Column, share: int) -> Column:
    """The text, or if it has more than `share` bytes, SLICES pieces of it of about that size together, one from each of as many equal parts."""
    part = F.floor(F.length(text) / SLICES).cast("int")
    size = F.greatest(F.floor(F.lit(share // SLICES) * F.length(text) / F.octet_length(text)).cast("int"), F.lit(1))
    at = [part * i + F.pmod(F.xxhash64(id_, F.lit(i)), F.greatest(part - size + 1, F.lit(1))).cast("int") + 1 for i in range(SLICES)]
    return F.when(F.octet_length(text) <= share, text).otherwise(F.concat_ws("\n", *[F.substring(text, a, size) for a in at]))


@lru_cache(maxsize=1)
def compressors(content: tuple[tuple[str, bytes], ...], level: int):
    import zstandard as zstd

    out = []
    for lang, data in content:
        d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def classify(texts: list[str | None], content: tuple[tuple[str, bytes], ...], block_bytes: int, level: int) -> list[tuple[str, float]]:
    """Language and score of each text; of each group of languages only the two smallest sizes are kept."""
    blocks: list[list[bytes]] = []
    for text in texts:
        raw = text.lower().encode() if text is not None and any(map(str.isalpha, text)) else b""
        blocks.append([raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)])
    least: list[list[tuple[int, int]]] = [[] for _ in texts]
    for g in range(0, len(content), GROUP):
        models = compressors(content[g : g + GROUP], level)
        for at, own in enumerate(blocks):
            if own:
                least[at] = sorted(least[at] + [(sum(len(c.compress(b)) for b in own), g + i) for i, (_, c) in enumerate(models)])[:2]
    out = []
    for two in least:
        if not two:
            out.append(("und", 0.0))
        elif len(two) == 1:
            out.append((content[two[0][1]][0], 1.0))
        else:
            out.append((content[two[0][1]][0], (two[1][0] - two[0][0]) / two[1][0]))
    return out


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.005, block_bytes: int = 1024, level: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score, rejected for every row; `keep` names columns to carry along."""
    frozen = tuple(content.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_id", compressors.cache_clear)
        for batch in batches:
            for part in slices_by_bytes(batch, "__text", SLICE_BYTES):
                got = classify(part.column("__text").to_pylist(), frozen, block_bytes, level)
                langs, scores = [g[0] for g in got], [g[1] for g in got]
                refuse = [g[0] == "und" or g[1] < min_margin for g in got]
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(refuse, pa.bool_())], names=[*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    names = list(dict.fromkeys([id_col, *keep]))
    cols: list[Column] = [place(docs, c).alias(f"__k{i}") for i, c in enumerate(names)]
    source = numbered(docs).select(*cols, place(docs, text_col).alias("__text"))
    schema = ", ".join(f"__k{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-1]))
    out = source.mapInArrow(run, schema + ", lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score", "rejected")
