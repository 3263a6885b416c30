"""Vectorised word hashing over Arrow text columns.

Helpers for the operators that look at word windows.  A *word* is a maximal run of
bytes outside a separator set; every separator set used here is ASCII, so runs of UTF-8
bytes and runs of code points are the same thing.  Hashes are 64-bit and are only
ever compared with each other; they are stable between runs and machines.

Null texts count as empty.  Empty texts have no words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

# The separators of `[^\x20\x09-\x0D]+`.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

_BLOCK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def separator_table(separators: bytes = SPACE_BYTES) -> np.ndarray:
    """256 booleans: which bytes separate words."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits of a hash are usable."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < n:
        size = max(n, _BLOCK + (1 << 12))
        base = np.full(size, _R, np.uint64)
        base[0] = 1
        inverse = np.full(size, np.uint64(pow(int(_R), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        _powers["r"], _powers["ri"] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers["r"], _powers["ri"]


class Words(NamedTuple):
    """Words of a batch of texts, in order: byte span in `data`, text index, hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of every text, the index of its first word; one entry more at the end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets (one more than there are texts) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashes: bool = True) -> Words:
    """All words of the texts.  Works in blocks of about a megabyte that end at a separator or text boundary."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends, hs = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + _BLOCK)
        while hi < n and not (edge[hi] or table[data[hi]]):
            step = table[data[hi : hi + 4096]] | edge[hi : hi + 4096][: len(data[hi : hi + 4096])]
            at = int(step.argmax())
            hi += at if step[at] else len(step)
        part = data[lo:hi]
        word = ~table[part]
        after = np.empty(len(part), bool)  # the next byte does not continue this word
        after[:-1] = ~word[1:]
        after[-1] = True
        after |= edge[lo + 1 : hi + 1]
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = ~word[:-1]
        before |= edge[lo:hi]
        s, e = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        if hashes and len(s):
            power, inverse = _power_tables(len(part))
            acc = _BYTE[part]
            acc *= power[: len(part)]
            acc = np.cumsum(acc, dtype=np.uint64)
            h = acc[e - 1]
            s0 = s > 0
            h[s0] -= acc[s[s0] - 1]
            h *= inverse[s]
            hs.append(mix(h))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, doc, h, first)


def window_hash(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive entries of h (len(h) - k + 1 of them), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    q = int(mix(np.array([int(_Q) + 2 * seed], np.uint64))[0]) | 1
    mask = (1 << 64) - 1
    out, done, piece, size = None, 0, h if seed == 0 else mix(h ^ np.uint64(q)), 1
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, done = piece, size
            else:
                out = out[: len(h) - done - size + 1] * np.uint64(pow(q, size, mask + 1)) + piece[done : done + len(h) - done - size + 1]
                done += size
        bits >>= 1
        if bits:
            piece = piece[:-size] * np.uint64(pow(q, size, mask + 1)) + piece[size:] if len(piece) > size else piece[:0]
            size *= 2
    return mix(out[: len(h) - k + 1])


def window_ok(words: Words, k: int) -> np.ndarray:
    """Which of the len - k + 1 windows lie inside one text."""
    n = len(words.doc)
    return words.doc[: n - k + 1] == words.doc[k - 1 :] if n >= k else np.zeros(0, bool)


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int):
    """Row slices of a batch whose texts hold about `limit` bytes together; a larger text stands alone.  Between them Arrow gives back memory it only keeps for later."""
    _, offsets = text_buffer(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()
        lo = hi
