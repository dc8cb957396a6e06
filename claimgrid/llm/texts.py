"""Vectorised text primitives over Arrow string columns.

A batch of texts is handled as one byte array with offsets, the form in which
Arrow delivers it. Words are runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); no word, line or shingle crosses a text boundary. A
null text behaves as an empty one here; operators decide what null means.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
# Texts are worked on in slices of about this many bytes, so that the arrays of
# a slice stay small however many rows an Arrow batch holds.
SLICE_BYTES = 1 << 20
_SHORT_WORD = 48

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Odd multipliers of the positions in a shingle.
_PLACE = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Bytes of several texts, one after the other, with their offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets.astype(np.int64)
        self.count = len(offsets) - 1
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the offsets of each text's words."""
        if self._words is None:
            ink = np.empty(len(self.data) + 2, dtype=bool)
            ink[0] = ink[-1] = False
            np.logical_not(_BLANK[self.data], out=ink[1:-1])
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(self.data))]
            begins = ink[1:-1] & ~ink[:-2]
            begins[inner] = ink[1:-1][inner]
            finishes = ink[1:-1] & ~ink[2:]
            finishes[inner - 1] = ink[1:-1][inner - 1]
            starts = np.flatnonzero(begins)
            ends = np.flatnonzero(finishes) + 1
            self._words = starts, ends, np.searchsorted(starts, self.offsets)
        return self._words

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each text."""
        return np.diff(np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))[self.offsets])

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        length = ends - starts
        h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        long = length > _SHORT_WORD
        active = np.flatnonzero(~long)
        at = starts[active]
        left = length[active]
        step = 0
        while len(active):
            h[active] = h[active] * np.uint64(0x100000001B3) + self.data[at + step]
            step += 1
            more = left > step
            active, at, left = active[more], at[more], left[more]
        h = mix(h)
        view = memoryview(self.data)
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
        return h

    def shingles(self, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in text order, and the offsets of each text's.

        A text of one to ``size - 1`` words has one shingle of all its words; a
        text without words has none.
        """
        hashes = self.word_hashes()
        _, _, at = self.words()
        n = np.diff(at)
        amount = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        offsets = np.concatenate(([0], np.cumsum(amount)))
        total = np.zeros(max(0, len(hashes)), dtype=np.uint64)
        padded = np.concatenate((hashes, np.zeros(size, dtype=np.uint64)))
        owner_end = np.repeat(at[1:], n)
        here = np.arange(len(hashes))
        places = np.resize(_PLACE, size) + np.arange(size, dtype=np.uint64) * np.uint64(2)
        for k in range(size):
            value = mix(padded[k : k + len(hashes)] + places[k])
            total = total * np.uint64(0x9E3779B185EBCA87) + np.where(here + k < owner_end, value, np.uint64(0))
        first = np.repeat(at[:-1], amount) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], amount))
        return mix(total[first]), offsets


def column(array: pa.Array | pa.ChunkedArray) -> Texts:
    """Texts of an Arrow string column; nulls become empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    if not len(array):
        return Texts(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch into runs of rows of about ``most`` text bytes, one row at least."""
    texts = column(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < texts.count:
        stop = int(np.searchsorted(texts.offsets, texts.offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), texts.count)
        lo, hi = texts.offsets[start], texts.offsets[stop]
        yield batch.slice(start, stop - start), Texts(texts.data[lo:hi], texts.offsets[start : stop + 1] - lo)
        start = stop
