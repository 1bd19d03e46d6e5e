"""Words and shingles of whole Arrow text columns as 64-bit hashes, without a Python loop per word.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case. Its hash is the
polynomial of its bytes modulo 2^64, read off one running sum over the column, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)
CHUNK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finisher of splitmix64)."""
    values = values + np.uint64(FACTOR)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(factor: int, n: int) -> np.ndarray:
    known = _powers.get(factor)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES), factor, dtype=np.uint64)
        known[0] = 1
        _powers[factor] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., then the same for every other run, in one array."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def row_chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_BYTES, or of one longer row."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows behind one another, and how many each row has."""
    text = LOWER[data[offsets[0]:offsets[-1]]]
    n, bounds = len(text), offsets - offsets[0]
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = ~SPACE[text]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    outside = np.concatenate([[True], ~inside, [True]])
    starts = np.flatnonzero(inside & (outside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (outside[2:] | edge[1:])) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, n), out=total[1:])
    values = (total[ends] - total[starts]) * powers(INVERSE, n)[starts]
    values = mix(values ^ mix((ends - starts).astype(np.uint64)))
    return values, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``k`` words, and how many they are.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    starts = np.cumsum(counts) - counts
    full = np.maximum(counts - k + 1, 0)
    sizes = np.where(counts == 0, 0, np.maximum(full, 1))
    at = ragged(starts, full)
    values = np.zeros(int(sizes.sum()), dtype=np.uint64)
    ends = np.cumsum(sizes)
    sums = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        sums += words[at + j] * factors[j]
    values[ragged(ends - sizes, full)] = sums
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[starts[row]:starts[row] + counts[row]]
        values[ends[row] - 1] = (own * factors[:len(own)]).sum() + np.uint64(len(own))
    values = mix(values)
    for begin, end in zip(ends - sizes, ends):
        values[begin:end].sort()
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    first[(ends - sizes)[sizes > 0]] = True
    distinct = np.diff(np.concatenate([[0], np.cumsum(first)])[np.concatenate([[0], ends])])
    return values[first], distinct


def column_shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of rows (begin, end) with their shingle sets, as of ``shingle_sets``."""
    data, offsets = utf8(column)
    for begin, end in row_chunks(offsets):
        words, counts = word_hashes(data, offsets[begin:end + 1])
        yield begin, end, *shingle_sets(words, counts, k)
