"""SuperMinHash signatures of many sets at once, in numpy.

Element e of a set draws, for step j = 0, 1, ..., a rank r in [0, 1) and the next place of a random
permutation of the m components (a Fisher-Yates shuffle of its own); component p keeps the least
j + r that is sent to it. The ranks of one element are thus correlated between components, which
lowers the variance, and a set stops as soon as every component holds a value below the next step.

All elements of a batch of sets go through step j together. The first steps follow a place back
through the few swaps made so far; only elements of sets that go on beyond them, which are the small
sets, get their permutation laid out.
"""

from __future__ import annotations

import numpy as np

from .textvec import mix

STEP = np.uint64(0x9E3779B97F4A7C15)


#: Steps that are worked out from the swaps themselves.
TRACED = 7


def signatures(elements: np.ndarray, set_of: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """Signatures (n_sets x m, uint32) of sets of distinct 64-bit hashes.

    A component holds step * 2**24 plus a 24-bit rank; all ones where a set is empty. m <= 256.
    """
    sig = np.full(n_sets * m, np.uint32(0xFFFFFFFF), np.uint32)
    swaps: list[np.ndarray] = []
    places: np.ndarray | None = None
    offsets = np.arange(1, m + 1, dtype=np.uint64) * STEP
    for j in range(m):
        if not len(elements):
            break
        draw = mix(elements + offsets[j])
        rank = (draw & np.uint64(0xFFFFFF)).astype(np.uint32) + np.uint32(j << 24)
        k = (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int32) + np.int32(j)
        if j == TRACED:
            places = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
            rows = np.arange(len(elements))
            for i, other in enumerate(swaps):
                moved = places[rows, other]
                places[rows, other] = places[rows, i]
                places[rows, i] = moved
        if places is None:
            place = k.copy()
            for i in range(j - 1, -1, -1):
                other = swaps[i]
                place = np.where(place == other, np.int32(i), np.where(place == i, other, place))
            swaps.append(k)
        else:
            rows = np.arange(len(elements))
            place = places[rows, k]
            places[rows, k] = places[rows, j]
        np.minimum.at(sig, set_of * m + place, rank)
        done = sig.reshape(n_sets, m).max(axis=1) < np.uint32(j + 1) << np.uint32(24)
        go = ~done[set_of]
        if not go.all():
            elements, set_of = elements[go], set_of[go]
            if places is None:
                swaps = [x[go] for x in swaps]
            else:
                places = places[go]
    return sig.reshape(n_sets, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band (n_sets x bands), different bands never sharing keys by design."""
    n, m = sig.shape
    rows = m // bands
    parts = sig[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, (n, bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key
