"""Words of whole texts as arrays: byte tables, runs of word bytes and 64-bit word hashes.

A batch of texts is one byte array with document offsets, so that each step is one pass of array code over many
documents. UTF-8 makes this exact: the word classes used here put every byte of a non-ASCII character on one side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of words [^\x20\x09-\x0D].
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False

_PRIME = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)
#: Words beyond this length are hashed one by one.
_LONG = 48
#: Bytes of text that are worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``size`` bytes; a null is empty."""
    first = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string()).fill_null("")
        n = len(part)
        if not n:
            continue
        _, where, data = part.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[part.offset : part.offset + n + 1]
        text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            j = min(j, n)
            yield first + i, first + j, text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        first += n


def words(text: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the count of all) of the runs of bytes in ``table``."""
    inside = np.zeros(len(text) + 2, dtype=bool)
    inside[1:-1] = table[text]
    inner = offsets[1:-1]
    begins = inside[1:] & ~inside[:-1]
    stops = inside[:-1] & ~inside[1:]
    # A document's end cuts a run that reaches it.
    cut = inner[inside[inner] & inside[inner + 1]] if len(inner) else inner
    begins[cut] = True
    stops[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    lengths = ends - starts
    out = np.full(len(starts), _SEED)
    order = np.argsort(-np.minimum(lengths, _LONG + 1).astype(np.int8), kind="stable")
    at, h = starts[order], out[order]
    alive = np.searchsorted(-lengths[order].clip(max=_LONG + 1), -np.arange(1, _LONG + 1), side="right")
    for k in range(_LONG):
        m = alive[k]
        if not m:
            break
        h[:m] = (h[:m] ^ text[at[:m] + k]) * _PRIME
    out[order] = h
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = np.uint64(xxhash.xxh64_intdigest(text[starts[i] : ends[i]].tobytes()))
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each ``n`` consecutive words; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : len(h) - n + 1 + j]
    return mix(out + np.uint64(n))
