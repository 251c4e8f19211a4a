"""Numpy helpers over the UTF-8 bytes of many texts at once; they run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
SEED = 20240229


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes without a copy, and where each text starts (one more for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def steps(ends: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; one row at least."""
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int = SEED) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and each text's first word index.

    A word's hash mixes a sum of its bytes times powers of an odd number with its length.
    """
    data = lower_ascii(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    within = np.arange(len(at)) - np.repeat(begin, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), odd_numbers(1)[0], np.uint64), dtype=np.uint64)
    sums = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[within], begin)
    return mix(sums + lengths.astype(np.uint64)), first


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, in order, of each text's runs of `size` words (all its words as one run where it
    has fewer; none without words), and where each text's hashes start."""
    counts = np.diff(first)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), each)
    at = np.arange(begin[-1]) - begin[owner] + first[owner]
    have = np.minimum(counts, size)[owner]
    factor = odd_numbers(size, SEED + 1)
    out = have.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for i in range(size):
        out = out * factor[i] + np.where(have > i, padded[at + i], np.uint64(0))
    out = mix(out)
    for i in range(len(counts)):
        out[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]
