"""Fast similarity sketching: every coordinate of every sketch fills, whatever the set's size.

Round i < t hashes each element into one of t bins with a value whose leading part is i; round
t + j puts every element into bin j. A bin keeps its smallest value. Rounds stop once a set's bins are
full: about t ln t / n rounds for n elements, and 2t at most. Two sets agree in a coordinate with
the probability of their Jaccard similarity, and the number of agreements is concentrated as for
sampling without replacement. After Dahlgaard, Knudsen and Thorup, FOCS 2017.
"""

from __future__ import annotations

import numpy as np

from rankweave.llm.kernels import U, mix

_EMPTY = np.uint64(2**64 - 1)


def sketch(rows: np.ndarray, hashes: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """A matrix of ``n_rows`` x ``t``; the row of an empty set keeps the largest value throughout.

    ``rows`` is ascending and numbers the set of each element from 0.
    """
    table = np.full(n_rows * t, _EMPTY)
    open_rows = np.unique(rows)
    low = U(2**48 - 1)
    for i in range(2 * t):
        if not len(rows):
            break
        value = mix(hashes + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = ((value >> U(48)) * U(t) >> U(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(table, rows * t + bins, (U(i) << U(48)) | (value & low))
        still = (table.reshape(n_rows, t)[open_rows] == _EMPTY).any(axis=1)
        if still.all():
            continue
        open_rows = open_rows[still]
        keep = np.zeros(n_rows, bool)
        keep[open_rows] = True
        chosen = keep[rows]
        rows, hashes = rows[chosen], hashes[chosen]
    return table.reshape(n_rows, t)


def bands(table: np.ndarray, per_band: int) -> np.ndarray:
    """One 64-bit key for each run of ``per_band`` coordinates, different for every band."""
    n, t = table.shape
    cut = table.reshape(n, t // per_band, per_band)
    keys = np.broadcast_to(mix(np.arange(1, t // per_band + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for k in range(per_band):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + cut[:, :, k])
    return keys
