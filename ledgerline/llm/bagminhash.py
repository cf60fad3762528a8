"""BagMinHash signatures of multisets: the share of equal components estimates the weighted Jaccard similarity without bias.

The weight axis is cut at 0, 1, 2, 4, 8 ...; each piece of it carries, for each element, its own Poisson process with the piece's
length as rate.  A point has a time, a signature component and a place in its piece, found by descending one hash bit for each
halving; it counts for a set in which the element's weight lies beyond that place.  A component keeps its earliest point, so two sets
agree there exactly if the earliest point of their union counts for both.  Points come in order of time, and a process ends once it
is later than every component of its set.
"""
from __future__ import annotations

import numpy as np

COMPONENTS = 128
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, components: int = COMPONENTS) -> np.ndarray:
    """One byte for each component of each set (rows), a hash of its earliest point.

    ``owner`` (below ``sets``), ``element`` (64-bit hashes, distinct within a set) and ``weight`` (whole numbers from 1) describe
    the sets; a set without element has a row of zeros.
    """
    levels = np.floor(np.log2(np.maximum(weight, 1))).astype(np.int64) + 2  # pieces [0, 1), [1, 2), [2, 4) ... that lie below the weight, in part at least
    levels -= weight == 1 << (levels - 2)
    at = np.repeat(np.arange(len(owner)), levels)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(piece == 0, 0, 1 << np.maximum(piece - 1, 0))
    size = np.where(piece == 0, 1, low)
    own, left = owner[at], weight[at] - low
    seed = mix(element[at] + (piece.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    time = np.zeros(len(at))
    first = np.full(sets * components, np.inf)
    step = 0
    while len(seed):
        step += 1
        a = mix(seed + np.uint64(step * int(_GOLDEN) % (1 << 64)))
        b = mix(a ^ _M2)
        time += -np.log1p(-((a >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / size
        counts = (b >> np.uint64(20)).astype(np.int64) % size < left
        slot = own * components + (b % np.uint64(components)).astype(np.int64)
        np.minimum.at(first, slot[counts], time[counts])
        if step > 16 and step % 8:
            continue
        go = time < first.reshape(sets, components).max(axis=1)[own]
        seed, time, own, left, size = seed[go], time[go], own[go], left[go], size[go]
    found = np.where(np.isinf(first), 0.0, first)
    return (mix(found.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).reshape(sets, components)
