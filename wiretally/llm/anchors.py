"""Content-chosen anchors of fixed-length byte windows, as numpy arrays over many texts that lie end to end.

Every window of ``length`` bytes picks the ``GRAM``-byte gram with the smallest hash inside it (leftmost on ties), so equal
windows pick the same gram at the same offset. Windows that follow one another mostly share their anchor; a *group* is a run of
windows with one anchor in one half of the window. Each group is keyed by a stretch of bytes that all its windows contain: from
the anchor on where the anchor lies in the first half, else from half a window before it. Equal windows are in groups with
equal stretches. There is one group for about 14 windows of 50 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GRAM = 8
SLAB = 1 << 20  # bytes worked on at a time, so that memory does not grow with a text
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    x ^= x >> np.uint64(32)
    x *= MIX2
    x ^= x >> np.uint64(29)
    return x


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as integers that sort as the bytes do."""
    wide = data.astype(np.uint64)
    for step in (1, 2, 4):
        wide = (wide[:-step] << np.uint64(8 * step)) | wide[step:]
    return wide


@dataclass
class Groups:
    """Runs of windows: ``first`` and ``last`` window, ``start`` of the keyed stretch, its 64-bit ``key``, index of the text."""

    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    key: np.ndarray
    owner: np.ndarray


def groups(data: np.ndarray, ends: np.ndarray, length: int) -> Groups:
    """All groups of the texts in ``data`` that end at ``ends``; windows never cross from one text into the next."""
    parts = [_slab(data[lo : lo + SLAB + length - 1], lo, ends, length) for lo in range(0, max(1, len(data) - length + 1), SLAB)]
    first, last, start, key = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return Groups(first, last, start, key, np.searchsorted(ends, first, side="right"))


def _slab(data: np.ndarray, lo: int, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    wide = grams(data)
    best = (mix(wide) & HIGH) | np.arange(len(wide), dtype=np.uint64)
    span, reach = 1, length - GRAM + 1
    while span * 2 <= reach:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < reach:
        best = np.minimum(best[: len(best) - (reach - span)], best[reach - span :])
    anchor = (best & LOW).astype(np.int64)
    at = np.arange(len(anchor), dtype=np.int64)
    half = (reach + 1) // 2
    late = anchor - at >= half
    near = np.searchsorted(ends, lo)  # the texts that end in or after this slab
    stop = ends[near : np.searchsorted(ends, lo + len(data), side="left") + 1] - lo
    stop = stop[stop > 0]
    crossing = np.zeros(len(at) + length + 1, np.int32)  # windows that start in the last length - 1 bytes of a text
    np.add.at(crossing, np.clip(stop - length + 1, 0, len(at)), 1)
    np.add.at(crossing, np.clip(stop, 0, len(at)), -1)
    valid = np.cumsum(crossing)[: len(at)] == 0
    change = np.ones(len(at), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (late[1:] != late[:-1]) | (valid[1:] != valid[:-1])
    inner = stop[stop < len(at)]
    change[inner] = True
    begin = np.flatnonzero(change)
    finish = np.append(begin[1:], len(at)) - 1
    ok = valid[begin]
    begin, finish = begin[ok], finish[ok]
    side = late[begin]
    start = anchor[begin] - np.where(side, half, 0)
    stretch = np.where(side, half + GRAM, length - half + 1)
    key = mix(wide[start] + side.astype(np.uint64))
    for step in range(8, min(length - half + 1, half + GRAM) - 8, 8):
        key = mix(key ^ wide[start + step])
    key = mix(key ^ wide[start + stretch - 8])
    return begin + lo, finish + lo, start + lo, key
