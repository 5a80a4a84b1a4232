"""Words of a batch of texts as arrays: where they are, and a 64-bit number for each.

Texts come as Arrow strings and are read as UTF-8 bytes. A word is a longest run of word bytes
within one text; all bytes from 0x80 on belong to words in both alphabets below, so no character is
cut. The number of a word is a polynomial over its bytes modulo 2**64, mixed afterwards; equal words
have equal numbers, and different ones practically never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20_240_501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WEIGHTS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: `[^\x20\x09-\x0D]+`
BETWEEN_SPACES = np.ones(256, bool)
BETWEEN_SPACES[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
LETTERS_AND_DIGITS = np.ones(256, bool)
LETTERS_AND_DIGITS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n - 1, and their inverses."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Bytes:
    """Texts one after the other: text r is data[first[r]:first[r + 1]]."""

    data: np.ndarray
    first: np.ndarray

    def sums(self) -> np.ndarray:
        """sums[i]: the polynomial over the first i bytes."""
        up, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=out[1:])
        return out

    def of(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Numbers of the pieces from start to end."""
        _, down = powers(len(sums))
        return mix((sums[end] - sums[start]) * down[start])


def bytes_of(texts: pa.Array) -> Bytes:
    """NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return Bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Word k is bytes start[k] to end[k]; text r has words first[r] to first[r + 1]."""

    text: Bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray
    number: np.ndarray

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def head(self, n: int) -> np.ndarray:
        """Numbers of the first n bytes of each word."""
        return self.text.of(self.start, np.minimum(self.start + n, self.end), self.sums)


def words_of(texts: pa.Array, alphabet: np.ndarray, lower: bool = True) -> Words:
    found = bytes_of(texts)
    if lower:
        found = Bytes(LOWER[found.data], found.first)
    inside = alphabet[found.data]
    n = len(inside)
    borders = found.first[(found.first > 0) & (found.first < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[borders] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[borders - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    sums = found.sums()
    number = found.of(start, end, sums)
    return Words(found, start, end, np.searchsorted(start, found.first), sums, number)


def runs(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each n that follow one another; len(numbers) - n + 1 of them."""
    size = max(0, len(numbers) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += numbers[k : k + size] * _WEIGHTS[k]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of text bytes, or with a single text."""
    if not len(batch):
        return
    first = bytes_of(batch.column(batch.schema.get_field_index(column))).first
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(first, first[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(batch))
        yield batch.slice(at, to - at)
        at = to


def nested(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column: row r has values[first[r]:first[r + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: row r has values[first[r]:first[r + 1]] as they lie in memory."""
    data = np.ascontiguousarray(values)
    offsets = np.asarray(first, np.int64) * data.itemsize
    if len(offsets) and offsets[-1] >= 1 << 31:
        raise ValueError("too much for one batch of binaries")
    offsets = pa.py_buffer(offsets.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, offsets, pa.py_buffer(data)])
