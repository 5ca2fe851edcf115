"""Vectorised word work on Arrow batches: word bounds and 64-bit word hashes without a Python loop over words.

A word is a maximal run of bytes other than space and tab..carriage return (0x20, 0x09-0x0D).
In UTF-8 these bytes never occur inside another character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each text in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return buf[lo:hi], offsets - lo


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` text bytes, or items of a list column (a longer row stands alone)."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = np.asarray(sizes.fill_null(0), dtype=np.int64)
    run = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


BLOCK = 1 << 20


def blocks(size: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes sum to about ``most``, so that per-byte arrays stay small."""
    if len(size):
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        edges = [0, *cuts.tolist(), len(size)]
        yield from zip(edges[:-1], edges[1:], strict=True)


@dataclass
class Words:
    """Words of consecutive texts: byte bounds of each word, and the first word of each text (one more at the end)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        power = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
        out = np.empty(len(size), np.uint64)
        for lo, hi in blocks(size):
            n = size[lo:hi]
            lead = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(lead, n)
            value = _BYTE[self.buf[within + np.repeat(self.start[lo:hi], n)]]
            value *= power[within]
            out[lo:hi] = np.add.reduceat(value, lead)
        return mix(out)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each; and where each word starts there (one more at the end)."""
        size = self.end - self.start + 1
        out_start = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(out_start[-1]), np.uint8)
        for lo, hi in blocks(size):
            a, b = out_start[lo], out_start[hi]
            at = np.arange(a, b) + np.repeat(self.start[lo:hi] - out_start[lo:hi], size[lo:hi])
            out[a:b] = self.buf[np.minimum(at, len(self.buf) - 1)]
        out[out_start[1:] - 1] = 32
        return out, out_start


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """The words of each text; ``gaps`` tells for each byte whether it stands between words."""
    if lower:
        buf = LOWER[buf]
    inside = ~gaps[buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    edges = offsets[1:] - 1
    after[edges[edges >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (runs may cross texts; callers mask those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * GRAM[0]
    for j in range(1, width):
        out += hashes[j : n + j] * GRAM[j]
    return mix(out)


def whole(first: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """For each word: does a run of ``width`` words that starts there end in the same text?"""
    stop = np.repeat(first[1:], np.diff(first))
    return np.arange(n_words) + width <= stop


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate byte ranges; returns the bytes and the offsets."""
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(offsets[-1]), buf.dtype)
    for lo, hi in blocks(size):
        a, b = offsets[lo], offsets[hi]
        out[a:b] = buf[np.arange(a, b) + np.repeat(start[lo:hi] - offsets[lo:hi], size[lo:hi])]
    return out, offsets
