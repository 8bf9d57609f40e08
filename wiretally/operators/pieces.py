"""Stretches of texts that may be one of many needles.

Needles are hashed by bytes from their begin on. A bit table of fixed size holds each whole needle, and of longer ones their beginnings of ``STEPS`` bytes. From each place
of a text the same hash goes on byte by byte, for as long as the table knows the beginning, and gives the stretches that the table knows as whole needles. No needle is
missed; of other stretches a few pass, so what passes is to be joined with the needles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB
ROOM = 32  # bits of a table that its size follows, for each needle
STEPS = (3, 5, 8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450, 700)
PLACES = 1 << 18  # taken at a time, so memory does not follow the texts' length
SIZE, LOOK = -1, -(1 << 30)  # words that are none of the table: a size of needles below -1, a needle to be looked at again

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WHOLE, _BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def _probes(hashes: np.ndarray, salt: np.uint64, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a table of 2 ** ``bits`` bits."""
    x = hashes ^ salt
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return (x & np.uint64((1 << bits) - 1)).view(np.int64), (x >> np.uint64(64 - bits)).view(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each text ends; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts), np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def stretches(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)
    offsets = np.concatenate([np.zeros(1, np.int64), ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


@dataclass(frozen=True)
class Marks:
    """``table`` of bits, the ``sizes`` of needles in bytes, and whether a needle's stretch does not tell all (``look``)."""

    table: np.ndarray
    sizes: tuple[int, ...]
    look: bool

    def _known(self, hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
        first, second = _probes(hashes, salt, len(self.table).bit_length() + 2)
        bit = lambda at: (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        passed = np.flatnonzero(bit(first))
        return passed[bit(second[passed]).astype(bool)]

    def places(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, begin, size) of the stretches that pass, a few at a time."""
        if not self.sizes:
            return
        if self.sizes[0] == 0 and len(ends):
            yield np.arange(len(ends)), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        wanted, most = set(self.sizes), self.sizes[-1]
        data = np.concatenate([data, np.zeros(most, np.uint8)])
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, PLACES):
            at = np.arange(begin, min(begin + PLACES, total))
            rows = np.searchsorted(ends, at, side="right")
            left = ends[rows] - at
            hashes, found, full = np.zeros(len(at), np.uint64), [], True
            for size in range(1, most + 1):
                letters = data[begin + size - 1 : begin + size - 1 + len(at)] if full else data[at + (size - 1)]
                hashes *= _FACTOR
                hashes += letters
                hashes += np.uint64(1)
                if size in wanted:
                    known = self._known(hashes, _WHOLE)
                    known = known[left[known] >= size]
                    if len(known):
                        found.append((rows[known], at[known], np.full(len(known), size)))
                if size in STEPS and size < most:
                    known = self._known(hashes, _BEGIN)
                    known = known[left[known] > size]
                    if not len(known):
                        break
                    at, rows, left, hashes, full = at[known], rows[known], left[known], hashes[known], False
            if found:
                yield tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _put(table: np.ndarray, needles: pa.Array) -> set[int]:
    """Enters needles into a table of one byte a bit; their sizes in bytes."""
    bits, sizes = len(table).bit_length() - 1, set()

    def put(hashes: np.ndarray, salt: np.uint64) -> None:
        for at in _probes(hashes, salt, bits):
            table[at] = True

    data, ends = text_bytes(needles)
    at = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)]
    left, hashes, size = ends - at, np.zeros(len(at), np.uint64), 0
    while len(at):
        whole = left == size
        if whole.any():
            sizes.add(size)
            put(hashes[whole], _WHOLE)
            at, left, hashes = at[~whole], left[~whole], hashes[~whole]
        if size in STEPS:
            put(hashes, _BEGIN)
        hashes = hashes * _FACTOR + data[at + size] + np.uint64(1)
        size += 1
    return sizes


def marks_of(needles: pa.Array) -> Marks:
    """The marks of needles (bytes) at hand; the table's size follows their number."""
    table = np.zeros(1 << min(BITS, max(10, (ROOM * len(needles)).bit_length())), bool)
    sizes = _put(table, needles)
    return Marks(np.packbits(table, bitorder="little"), tuple(sorted(sizes)), False)


def piece_marks(needles: DataFrame) -> Marks:
    """The marks of needles ``piece`` (bytes) with ``look``, made where these lie; the driver gets a table of fixed size and the sizes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes, look = np.zeros(1 << BITS, bool), set(), False
        for batch in batches:
            look = look or bool(np.any(batch.column(1).to_numpy(zero_copy_only=False)))
            sizes |= _put(table, batch.column(0))
        words = np.packbits(table, bitorder="little").view(np.int64)
        filled = np.flatnonzero(words)
        extra = [SIZE - size for size in sizes] + [LOOK] * look
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([filled, np.array(extra, np.int64)])), pa.array(np.concatenate([words[filled], np.zeros(len(extra), np.int64)]))], ["word", "bits"])

    marked = needles.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, bits = (marked[name].to_numpy() for name in ("word", "bits"))
    table, real = np.zeros(1 << (BITS - 6), np.int64), word >= 0
    table[word[real]] = bits[real]
    sizes = tuple(sorted((SIZE - word[(word < 0) & (word > LOOK)]).tolist()))
    return Marks(table.view(np.uint8), sizes, bool((word == LOOK).any()))
