"""Vectorised words, hashes and shingles of whole texts inside Arrow batches.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which in UTF-8 is the same as
runs of characters other than those. A null text has no words. Word hashes are 64 bits wide and mix
every byte of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
M1, M2, M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= M1
    x ^= x >> U64(27)
    x *= M2
    x ^= x >> U64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together hold about ``most`` bytes; one longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def offsets_of(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts)."""
    if array.null_count:
        array = array.fill_null("")
    ends = offsets_of(array)
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


class Words:
    """The words of a run of texts: byte ranges, 64-bit hashes, and each text's first word (``first``)."""

    def __init__(self, array: pa.Array, lower: bool = False):
        flat, self.text_at = text_bytes(array)
        self.raw = flat
        if lower:
            flat = LOWER[flat]
        n = len(flat)
        space = SPACE[flat]
        begins = np.ones(n, bool)
        begins[1:] = space[:-1]
        cuts = self.text_at[:-1]
        begins[cuts[cuts < n]] = True
        ends = np.ones(n, bool)
        ends[:-1] = space[1:]
        ends[self.text_at[1:][self.text_at[1:] > 0] - 1] = True
        self.start = np.flatnonzero(begins & ~space)
        self.end = np.flatnonzero(ends & ~space) + 1
        self.first = np.searchsorted(self.start, self.text_at)
        self.hash = self._hash(flat)

    def _hash(self, flat: np.ndarray) -> np.ndarray:
        data = np.concatenate([flat, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(flat) + 1, "<u8", data.data, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(U64) + M3)
        rest, at, left = None, self.start, size
        while True:
            part = eight[at]
            short = left < 8
            keep = (U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1)
            part = np.where(short, part & keep, part)
            if rest is None:
                h = mix(h ^ part)
                rest = np.flatnonzero(size > 8)
            else:
                h[rest] = mix(h[rest] * M3 ^ part)
                rest = rest[left > 8]
            if not len(rest):
                return h
            at, left = at[left > 8] + 8, left[left > 8] - 8

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; those that leave their text are not valid (see ``whole``)."""
        n = len(self.hash)
        out = np.zeros(n, U64)
        if n >= k:
            roll = self.hash[: n - k + 1].copy()
            for j in range(1, k):
                roll *= M3
                roll += self.hash[j : n - k + 1 + j]
            out[: n - k + 1] = mix(roll)
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in its text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))
        return left >= k


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling; the last w - 1 entries are minima of what is there."""
    out, span = x.copy(), 1
    while span < w:
        step = min(span, w - span)
        if len(out) > step:
            out[:-step] = np.minimum(out[:-step], out[step:])
        span += step
    return out
