"""Words of whole texts as 64-bit hashes, a slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes of text that byte-wise arrays are made for at a time
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(4)
def byte_values(seed: int = 1) -> np.ndarray:
    """A random odd number for each byte; A-Z have those of a-z."""
    v = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    v[65:91] = v[97:123]
    return v


@lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole texts of up to ``most`` bytes; a longer
    text comes alone."""
    data, at = flat(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


@lru_cache(8)
def word_bytes(kind: str) -> np.ndarray:
    """True for the bytes of words: "space" for [^\\x20\\x09-\\x0D], "alnum" for [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]
    after folding A-Z."""
    ok = np.ones(256, bool)
    if kind == "space":
        ok[[32, *range(9, 14)]] = False
    else:
        ok[:128] = False
        ok[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    return ok


def word_hashes(data: np.ndarray, at: np.ndarray, kind: str, spots: bool = False) -> tuple:
    """The hash of each word, A-Z folded to a-z, and the n + 1 places where texts begin among them;
    with spots also the words' first bytes and ends. Byte-wise arrays are made for SLICE bytes at a time, cut between words."""
    ok, values = word_bytes(kind), byte_values()
    hashes, starts_of, ends_of, lo, n = [], [], [], 0, len(data)
    firsts = np.zeros(n + 1, bool)
    firsts[at] = True
    while lo < n:
        hi = min(n, lo + SLICE)
        while hi < n and not firsts[hi] and ok[data[hi]] and ok[data[hi - 1]]:
            hi += 1
        part, first = data[lo:hi], firsts[lo : hi + 1]
        w = ok[part]
        start = w.copy()
        start[1:] &= ~w[:-1] | first[1:-1]
        end = w.copy()
        end[:-1] &= ~w[1:] | first[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        size = max(SLICE, hi - lo)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers(size, int(_BASE))[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * powers(size, int(_BACK))[s] + (e - s).astype(np.uint64)))
        starts_of.append(s + lo)
        if spots:
            ends_of.append(e + lo)
        lo = hi
    if not hashes:
        none = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), np.zeros(len(at), np.int64), *([none, none] if spots else []))
    starts = np.concatenate(starts_of)
    return (np.concatenate(hashes), np.searchsorted(starts, at), *([starts, np.concatenate(ends_of)] if spots else []))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n consecutive words, sorted; of fewer words, the hash of the whole sequence."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, U(k))
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i]
        out ^= out >> U(32)
    return np.unique(mix(out))
