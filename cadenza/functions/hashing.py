"""Deterministic fractions, seeds and pseudonyms from SHA-256."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed text in the payload of user-level fractions (a fixed value: it decides the splits).
SPLIT_SEED = "20260722"


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def unit_fraction(payload: Column) -> Column:
    """First eight digest bytes, big-endian, over 2^64: a double in [0, 1]."""
    return F.conv(F.substring(_digest(payload), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def stable_fraction(namespace: str, key: Column, seed: str = SPLIT_SEED) -> Column:
    """Fraction of `seed|namespace|key`."""
    return unit_fraction(F.concat_ws("|", F.lit(seed), F.lit(namespace), key.cast("string")))


def row_fraction(namespace: str, *keys: Column) -> Column:
    """Fraction of `namespace|key|key...`, for rows; no seed."""
    return unit_fraction(F.concat_ws("|", F.lit(namespace), *[k.cast("string") for k in keys]))


def pseudonym(domain: str, label: Column, value: Column) -> Column:
    """First 20 hex digits of the digest of domain, label and value, each ended by a zero byte."""
    zero = F.lit("00").cast("string")
    framed = F.concat(F.lit(domain).cast("binary"), F.unhex(zero), label.cast("binary"), F.unhex(zero),
                      value.cast("string").cast("binary"))
    return F.substring(F.sha2(framed, 256), 1, 20)


def _word(digest_hex: Column, little: bool) -> Column:
    pairs = [F.substring(digest_hex, 1 + 2 * i, 2) for i in range(4)]
    return F.conv(F.concat(*(reversed(pairs) if little else pairs)), 16, 10).cast("long")


def stable_seed(text: Column) -> Column:
    """First eight digest bytes read little-endian, modulo 2^32: the first four bytes, little-endian."""
    return _word(_digest(text), True)


def offset_seed(base: int, text: Column, little: bool = False) -> Column:
    """(base + first four digest bytes) modulo 2^32, in either byte order."""
    return F.pmod(F.lit(base) + _word(_digest(text), little), F.lit(1 << 32))


def xxhash64_chain(parts: list[tuple]) -> np.ndarray:
    """Spark's xxhash64 over whole-number columns as NumPy arrays (broadcast against each other): (values, whether they are longs, where they are not null)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    seed = np.full((1,) * max(v.ndim for v, *_ in parts), 42, np.uint64)
    for values, is_long, valid in parts:
        x = values.astype(np.int64).view(np.uint64)
        if is_long:
            h = (seed + p5 + np.uint64(8)) ^ (turned(x * p2, 31) * p1)
            h = turned(h, 27) * p1 + p4
        else:
            h = (seed + p5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * p1)
            h = turned(h, 23) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
        seed = h if valid.all() else np.where(valid, h, seed)
    return seed.view(np.int64)
