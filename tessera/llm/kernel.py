"""Vectorised text kernel shared by the operators: bytes of a batch of documents -> word spans, word hashes, windows.

A batch of Arrow strings is viewed as one byte buffer plus document offsets.  Word
boundaries, lower-casing and 64-bit word hashes are then a handful of numpy passes over
that buffer; no Python object is made per word.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _SEED = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
BASE = U64(0x9FB21C651E98DF25)  # odd, so that it has an inverse modulo 2**64
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.  All of UTF-8 beyond ASCII belongs to words.
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers that spreads all bits."""
    x = x + _SEED
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string array; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between documents so that each piece has about `limit` bytes of text."""
    if batch.num_rows == 0:
        return
    _, offs = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def word_spans(buf: np.ndarray, offs: np.ndarray, kinds: np.ndarray = BLANK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (one more at the end)."""
    n = len(buf)
    inside = kinds[buf]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(U64))
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(left, 8)]))
    k, rest = 8, np.flatnonzero(left > 8)
    while len(rest):
        size = left[rest] - k
        h[rest] = mix(h[rest] ^ (eight[starts[rest] + k] & _MASKS[np.minimum(size, 8)]))
        k += 8
        rest = rest[size > 8]
    return h


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, U64(base))
    p[0] = 1
    return np.cumprod(p, dtype=U64)


def powers(n: int, base: U64) -> np.ndarray:
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size, int(base))[:n]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (also those across documents, to be masked by the caller)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out, b = h[:n].copy(), U64(1)
        for j in range(1, k):
            b = U64((int(b) * int(BASE)) & 0xFFFFFFFFFFFFFFFF)
            out += h[j : j + n] * b
        return mix(out)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(len(h), BASE), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(n, BASE_INV))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Index of each word at which a window of k words of one document starts."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + base


def doc_of(first: np.ndarray) -> np.ndarray:
    """Row number of the document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the words' values in each document."""
    sums = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
