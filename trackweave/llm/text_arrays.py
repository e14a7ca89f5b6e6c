"""Vectorised text helpers that run inside Arrow map tasks.

A block of texts is one flat array of UTF-8 bytes plus document offsets, so words, hashes and
shingles are found with array operations and no Python object is made per word. All functions are
pure; Spark decides which rows a task sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time inside a task; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes whose words are hashed at once: some arrays of eight times as many bytes are made for them.
SLICE_BYTES = 1 << 18

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Byte -> lower-cased byte, A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\\x20\\x09-\\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; every row is in exactly one."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased bytes, and for each row the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    here = inside[1:-1]
    opens, closes = here & ~inside[:-2], here & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = here[edges]
    closes[edges - 1] = here[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands. Words are taken in slices of about SLICE_BYTES."""
    out, first = np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base : ends[last - 1]]
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power("up", _PRIME, len(part)), out=prefix[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((prefix[b] - prefix[a]) * _power("down", _INVERSE, len(part) + 1)[a])
        first = last
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and for each row the index of its first shingle.

    A row of fewer than k words, but at least one, has a single hash of its whole sequence; a row
    without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    begin = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    size = np.minimum(counts[row], k)
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        live = size > j
        out[live] = mix(out[live] * np.uint64(_PRIME) + words[begin[live] + j])
    return out, at


def range_hashes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of word hashes, the same wherever the range stands."""
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power("up", _PRIME, len(words)), out=prefix[1:])
    return mix((prefix[ends] - prefix[begins]) * _power("down", _INVERSE, len(words) + 1)[begins])
