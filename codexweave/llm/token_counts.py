"""Token counts of whole texts, huge ones in overlapping chunks that are spliced exactly.

A text of up to `chunk_chars` code points is encoded at once.  A longer one is encoded in chunks
that overlap, each with the offsets of its tokens.  Two neighbouring chunks are spliced at a
position inside their overlap where both have a token boundary and that is *proven* stable: the
two characters around it stand side by side in no piece of the vocabulary, so no merge, in
any context, can join them, and tokens on one side do not depend on the other side.  Where the
overlap holds no such position it is doubled, and in the end the chunk itself grows, up to the
rest of the text: the count is always that of the whole text.

The proof needs a model that leaves characters as they are (spaces apart).  The splitter checks
the normal form of every chunk and encodes the text as a whole if one differs.

Defined results: null or empty text: 0 bytes, 0 tokens.  Rows with equal ids are counted
separately.  Columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, hold, pick
from .words import slices_by_bytes

SPACE = "▁"  # how the vocabulary writes a space


class Splitter:
    """Counts tokens of texts with one sentencepiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.joined = set()
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)):
                piece = self.sp.id_to_piece(i)
                self.joined.update(map("".join, zip(piece, piece[1:])))

    def stable(self, text: str, at: int) -> bool:
        """No piece holds the characters on both sides of `at` side by side."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def plain(self, text: str) -> bool:
        """The normal form is the text itself, after the one space that the model puts before it."""
        return self.sp.normalize(text) == (SPACE + text.replace(" ", SPACE) if text else "")

    def token_starts(self, text: str, lo: int, hi: int) -> list[int]:
        return [lo + b for b, _ in self.sp.encode_as_offset_mapping(text[lo:hi])["offsets"]]

    def count_whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode_as_numpy(texts, num_threads=1)] if texts else []

    def pieces(self, text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, tokens) of consecutive parts of the text, cut at stable boundaries."""
        n, lo, done = len(text), 0, 0
        hi = min(n, chunk)
        starts = self.token_starts(text, lo, hi)
        while hi < n:
            width = overlap
            while True:
                left = max(done + 1, hi - width)
                right = min(n, left + max(chunk, 2 * width))
                following = self.token_starts(text, left, right)
                both = set(starts) & set(following)
                cut = next((p for p in sorted(both, reverse=True) if left < p < hi and p > done and self.stable(text, p)), None)
                if cut is not None:
                    break
                if left > done + 1:
                    width *= 2  # alignment failed: look at a wider overlap
                else:
                    hi = min(n, done + 2 * (hi - done))  # no boundary in the whole chunk: it grows
                    starts = self.token_starts(text, lo, hi)
                    width = overlap
                    if hi == n:
                        break
            if hi == n and cut is None:
                break
            yield done, cut, sum(done <= b < cut for b in starts)
            done, lo, hi, starts = cut, left, right, following
        yield done, n, sum(b >= done for b in starts)

    def count(self, text: str, chunk: int, overlap: int) -> tuple[int, int]:
        """Tokens, and the number of parts that were counted apart (0: the text was encoded at once)."""
        if len(text) <= chunk or not all(self.plain(text[i : i + chunk + 1]) for i in range(0, len(text), chunk)):  # chunks share a character, so that every pair is seen
            return self.count_whole([text])[0], 0
        parts = [k for _, _, k in self.pieces(text, chunk, overlap)]
        return sum(parts), len(parts)


@lru_cache(maxsize=2)
def splitter(model_file: str) -> Splitter:
    return Splitter(model_file)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 10) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than `limit` tokens) and n_chunked (the parts of a text that were counted apart and spliced, 0 for a text encoded at once)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", splitter.cache_clear)
        s = splitter(model_file)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                short = iter(s.count_whole([t for t in texts if len(t) <= chunk_chars]))
                counts = [(next(short), 0) if len(t) <= chunk_chars else s.count(t, chunk_chars, overlap_chars) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array([n for n, _ in counts], pa.int64()), pa.array([k for _, k in counts], pa.int64())], names=["id", "n_bytes", "n_tokens", "n_chunked"])

    cols = pick(docs, id=id_col, text=text_col).select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = cols.schema["id"].dataType.simpleString()
    out = cols.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, n_chunked long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunked")
