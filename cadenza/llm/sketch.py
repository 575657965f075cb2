"""Fast similarity sketching: rounds of hashed bin placement.

A set goes through 2t rounds.  In round i < t every element is thrown into a hashed bin
with value (i, hash); in round i >= t every element goes to bin i - t.  A bin keeps its
least value, and a set stops as soon as its t bins are full, which is certain after 2t
rounds.  Large sets need one or two rounds, so a sketch costs O(n + t log t), and two
sets agree in a coordinate with probability equal to their Jaccard similarity, with
concentration as for independent samples.
"""

from __future__ import annotations

import math

import numpy as np

from .textcore import U, mix, seed_values

_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def bands_for(similarity: float, rows: int, miss: float = 1e-6) -> int:
    """Bands of `rows` coordinates so that a pair at `similarity` is missed with probability under `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def sketches(values: np.ndarray, ends: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """(sets, t) array of 16-bit coordinates; rows of empty sets are zero."""
    n = len(ends) - 1
    sizes = np.diff(ends)
    out = np.full(n * t, _EMPTY, dtype=U)
    seeds = seed_values(2 * t, seed)
    active = np.flatnonzero(sizes > 0)
    rows = np.repeat(np.arange(n, dtype=np.int64), sizes)
    held = values
    for i in range(2 * t):
        if not len(active):
            break
        z = mix(held ^ seeds[i])
        bins = ((z >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, rows * t + bins, U(i << 32) | (z & U(0xFFFFFFFF)))
        full = (out.reshape(n, t)[active] != _EMPTY).all(axis=1)
        if full.any():
            open_row = np.zeros(n, dtype=bool)
            active = active[~full]
            open_row[active] = True
            keep = open_row[rows]
            rows, held = rows[keep], held[keep]
    got = (mix(out) >> U(48)).astype(np.uint16).reshape(n, t)
    got[sizes == 0] = 0
    return got


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys; two sets share a key when `rows` coordinates agree."""
    n, t = coordinates.shape
    bands = t // rows
    part = coordinates[:, : bands * rows].reshape(n, bands, rows).astype(U)
    constants = seed_values(rows, 99)
    keys = (mix(part + U(1)) * constants).sum(axis=2, dtype=U)
    return mix(keys + seed_values(bands, 7))
