"""Vectorised text primitives shared by the text operators of this subpackage.

Every function works on one *slice* of an Arrow batch: the UTF-8 bytes of several
documents laid end to end, plus the offsets between them.  Null texts count as
empty.  All hashes are 64-bit and depend on nothing but the bytes, so that they are
the same in every task, attempt and executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_STEP = np.cumprod(np.full(16, 0xD6E8FEB86659FD93, dtype=np.uint64))

#: The bytes that end a word (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that a task handles at once: it bounds the memory of the numpy work, whose arrays of eight bytes a byte then fit a core's cache.
SLICE_BYTES = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in ((0, _BASE), (1, _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, end to end, and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        width = np.int64
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most `most` bytes of column `name` each, or of one row."""
    _, offsets = column_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice, A-Z lower-cased, with a 64-bit code each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = _LOWER[data], offsets
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        text = ~_IS_SPACE[data]
        before = np.ones(n, dtype=bool)
        before[1:] = ~text[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~text[1:]
        self.starts = np.flatnonzero(text & (before | edge[:-1]))
        self.ends = np.flatnonzero(text & (after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of row i: bounds[i] to bounds[i + 1]
        self.counts = np.diff(self.bounds)
        self.codes = span_codes(prefix_codes(self.data), self.starts, self.ends)


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Running polynomial code of the bytes; span_codes reads any substring's code from it."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_codes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the substrings from starts to ends."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _WORD_STEP[3])


def gram_codes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row bounds) of each row's runs of `size` words; a row with fewer words but one at least has its whole sequence as one."""
    codes, counts = words.codes, words.counts
    n = len(codes)
    rows = np.repeat(np.arange(len(counts)), counts)
    if n >= size:
        full = codes[: n - size + 1] * _WORD_STEP[0]
        for j in range(1, size):
            full = full + codes[j : n - size + 1 + j] * _WORD_STEP[j]
        full = mix(full + U64(size))
        inside = rows[: n - size + 1] == rows[size - 1 :]
        grams, gram_rows = full[inside], rows[: n - size + 1][inside]
    else:
        grams, gram_rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([sequence_code(codes[words.bounds[i] : words.bounds[i + 1]]) for i in short], dtype=np.uint64)
        order = np.argsort(np.concatenate([gram_rows, short]), kind="stable")
        grams, gram_rows = np.concatenate([grams, whole])[order], np.concatenate([gram_rows, short])[order]
    return grams, np.searchsorted(gram_rows, np.arange(len(counts) + 1))


def sequence_code(codes: np.ndarray) -> np.uint64:
    """The code of one run of word codes; the same as in gram_codes."""
    return mix(np.array([(codes * _WORD_STEP[: len(codes)]).sum(dtype=np.uint64) + U64(len(codes))]))[0]


def distinct_by_row(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct codes in ascending order, and the new bounds."""
    parts = [np.unique(codes[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return out, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def row_reduce(how: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """how.reduce of each row's values; `empty` for rows without any."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = how.reduceat(values, bounds[:-1][full])
    return out
