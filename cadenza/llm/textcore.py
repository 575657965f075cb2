"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Words are found on the UTF-8 bytes of a whole
batch at once and become 64-bit hashes, so no Python object is made per word.
Hashes are deterministic across processes and machines (fixed seeds).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64

# Freed batches go back to the system at once: idle workers of one stage stand beside the next stage's heap.
pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Gives freed memory back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def trimmed(run):
    """A batch function that gives freed memory back to the system when its partition ends."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped

_BASE = U(0x9E3779B97F4A7C55)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text handled at once; one longer text is still handled whole, alone.
CHUNK_BYTES = 1 << 20

ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])
#: Everything in ASCII but digits and lower-case letters (texts are lower-cased first).
ASCII_NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seed_values(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


class Alphabet:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    def __init__(self, delimiters: bytes, lower: bool):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[list(delimiters)] = False
        values = mix(np.arange(256, dtype=U) + U(0x5851F42D4C957F2D))
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
            if not self.is_word[65]:
                self.is_word[65:91] = self.is_word[97:123]
        self.value = values[self.fold]


SPACED = Alphabet(ASCII_SPACE, lower=False)
SPACED_LOWER = Alphabet(ASCII_SPACE, lower=True)
ALNUM_LOWER = Alphabet(ASCII_NON_ALNUM, lower=True)

_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(n, base, dtype=U)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=U)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string array; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator:
    """Slices of a batch holding about `limit` bytes of text each."""
    _, ends = text_buffers(batch.column(column))
    start = 0
    n = len(ends) - 1
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """The words of a batch of texts: byte spans, owning row, 64-bit hash."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, alphabet: Alphabet, hashes: bool = True):
        n = len(ends) - 1
        inside = alphabet.is_word[raw]
        before = np.zeros(len(raw) + 1, dtype=bool)
        before[1:] = inside
        after = np.zeros(len(raw) + 1, dtype=bool)
        after[:-1] = inside
        cut = ends[(ends > 0) & (ends < len(raw))]
        opened = inside & ~before[:-1]
        closed = inside & ~after[1:]
        opened[cut] = inside[cut]
        closed[cut - 1] = inside[cut - 1]
        self.starts = np.flatnonzero(opened)
        self.stops = np.flatnonzero(closed) + 1
        self.row = np.searchsorted(ends, self.starts, side="right") - 1
        self.n_words = np.bincount(self.row, minlength=n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)]).astype(np.int64)
        if hashes:
            power, inverse = _power_tables(len(raw) + 1)
            total = np.zeros(len(raw) + 1, dtype=U)
            np.cumsum(alphabet.value[raw] * power[: len(raw)], dtype=U, out=total[1:])
            size = (self.stops - self.starts).astype(U)
            self.hash = mix((total[self.stops] - total[self.starts]) * inverse[self.starts] + size)

    def within(self, k: int) -> np.ndarray:
        """Positions where k consecutive words lie in one row."""
        if len(self.row) < k:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words that start at each position (only `within(k)` are of one row)."""
        return gram_hashes(self.hash, k)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    if k <= 8:
        c = seed_values(k, 17 * k)
        out = words[:n] * c[0]
        for j in range(1, k):
            out = out + words[j : j + n] * c[j]
        return mix(out)
    power, inverse = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * power[: len(words)], dtype=U, out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:n] + U(k))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every row, ascending, and n+1 offsets.

    A row of fewer words (but not none) has its whole sequence as its one shingle;
    a row without words has an empty set.
    """
    at = words.within(k)
    values, rows = words.grams(k)[at], words.row[at]
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < k))
    if len(short):
        extra = np.zeros(len(short), dtype=U)
        for i, r in enumerate(short):
            own = words.hash[words.first[r] : words.first[r + 1]]
            extra[i] = gram_hashes(own, len(own))[0] ^ U(0x5BD1E995 * len(own))
        values, rows = np.concatenate([values, extra]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[keep], rows[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(words.n_words)))]).astype(np.int64)
