"""Hashes of the words of whole Arrow batches, by array operations alone: no object per word.

Words are what ASCII white space separates; A-Z are lowered. A word's hash is the sum of a
mix of each of its bytes with its place in the word, mixed again with the length. Words of
more than ``LONG`` bytes are hashed by xxhash instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LONG = 1024
PART = 1 << 20  # bytes hashed at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of lowered bytes, given by their bounds."""
    sizes = ends - starts
    if not len(sizes):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    place -= np.repeat(first, sizes)
    letters = data[np.repeat(starts, sizes) + place]
    mixed = spread((place.astype(np.uint64) << np.uint64(8)) + letters.astype(np.uint64) + np.uint64(1))
    return spread(np.add.reduceat(mixed, first) + sizes.astype(np.uint64))


def _bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; ``at``: positions where a text begins."""
    inside = ~_GAP[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[at] = True
    starts = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word and the end), for a column of texts.

    Null texts have no words.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, starts_all = [], []
    at = 0
    while at < len(data):
        to = min(at + PART, len(data))
        if to < len(data):  # end the part behind a gap or at the start of a text
            gaps = np.flatnonzero(_GAP[data[at:to]])
            inner = offsets[(offsets > at) & (offsets <= to)]
            to = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, int(inner[-1]) if len(inner) else 0)
            if to <= at:  # the word is longer than a part: it goes as far as the next gap or text
                to = at
                stop = int(offsets[np.searchsorted(offsets, at, side="right")])
                while to < stop:
                    gaps = np.flatnonzero(_GAP[data[to:min(to + PART, stop)]])
                    to = to + int(gaps[0]) if len(gaps) else min(to + PART, stop)
                    if len(gaps):
                        break
                hashes.append(np.array([_long(data, at, to)], dtype=np.uint64))
                starts_all.append(np.array([at]))
                at = to
                continue
        part = _LOWER[data[at:to]]
        lo, hi = np.searchsorted(offsets, at), np.searchsorted(offsets, to, side="right")
        starts, ends = _bounds(part, offsets[lo:hi] - at)
        long = ends - starts > LONG
        h = np.empty(len(starts), dtype=np.uint64)
        h[~long] = _hashed(part, starts[~long], ends[~long])
        for i in np.flatnonzero(long):
            h[i] = _long(part, starts[i], ends[i])
        hashes.append(h)
        starts_all.append(starts + at)
        at = to
    starts = np.concatenate(starts_all) if starts_all else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.searchsorted(starts, offsets)


def _long(data: np.ndarray, at: int, to: int) -> int:
    """The hash of one long word, lowered part by part."""
    state = xxhash.xxh3_64()
    for i in range(at, to, PART):
        state.update(_LOWER[data[i:min(i + PART, to)]].tobytes())
    return state.intdigest()
