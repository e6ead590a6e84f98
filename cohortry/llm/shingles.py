"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Everything works on the UTF-8 bytes of an Arrow string array, some megabytes of text at a time, so memory doesn't follow the
number of rows. The word rule is that of `base.WORD`, on A-Z lower-cased text. A text's set has its distinct five-word
shingles; with fewer words, the whole sequence as one; without words (or null) it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
LONG_WORD = 48
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def slices(texts: pa.Array, fold: np.ndarray = _FOLD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows with up to SLICE_BYTES, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, fold[every[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    solid = ~gap[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    some = offsets[:-1] < offsets[1:]
    before[offsets[:-1][some]] = False
    after[offsets[1:][some] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    h = np.full(len(start), 0xCBF29CE484222325, U) ^ size.astype(U)
    live = np.arange(len(start))
    for k in range(LONG_WORD):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = (h[live] ^ data[start[live] + k]) * U(0x100000001B3)
    for i in live[size[live] > LONG_WORD]:
        rest = data[start[i] + LONG_WORD : end[i]].astype(U)
        for k in range(0, len(rest), 1 << 16):
            part = rest[k : k + (1 << 16)]
            h[i] = mix(h[i : i + 1] ^ np.bitwise_xor.reduce(mix((part << U(32)) | np.arange(len(part), dtype=U)), keepdims=True))[0]
    return mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each row, number for each row) of the rows' sets."""
    start, end, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    w = word_hashes(data, start, end)
    words = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    n = np.where(words >= k, words - k + 1, (words > 0).astype(words.dtype))
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    long = np.repeat(words >= k, n)
    h = np.empty(len(at), U)
    whole = at[long]
    g = w[whole]
    for i in range(1, k):
        g = g * U(0x9E3779B97F4A7C15) + w[whole + i]
    h[long] = g
    short = at[~long]
    if len(short):
        size = words[row[short]]
        g = w[short]
        for i in range(1, k - 1):
            more = size > i
            g[more] = g[more] * U(0x9E3779B97F4A7C15) + w[short[more] + i]
        h[~long] = g ^ mix(size.astype(U))
    h = mix(h)
    ends = np.cumsum(n)
    for i in np.flatnonzero(n > 1):
        h[ends[i] - n[i] : ends[i]].sort()
    of = np.repeat(np.arange(rows), n)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=rows)


def set_of(text: str | None) -> np.ndarray:
    """The sorted hashes of one text's set."""
    data = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return shingle_sets(data, np.array([0, len(data)]))[0]
