"""Vectorised byte and word hashing shared by the text operators.

Texts of one slice of an Arrow batch are laid end to end with a space between
them, so one pass of array operations serves all of them. Hashes are 64-bit
polynomials over a random byte table, taken modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240611)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: A second table, for a second hash of the same bytes.
OTHER_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
ROOT = 0x9E3779B97F4A7C15 | 1
ROOT_INVERSE = pow(ROOT, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space as the shingle contract names it: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII digits, letters and bytes of non-ASCII characters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x41:0x5B] = False
NOT_ALNUM[0x61:0x7B] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * U(pow(base, done, 2**64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def release() -> None:
    """Give memory that is not in use back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * ROOT**i, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(ROOT, len(values)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever its place."""
    inverse = powers(ROOT_INVERSE, max(1, len(sums)))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def slices(column: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each of about `limit` bytes (or one row)."""
    if not len(column):
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
        yield start, stop
        total, start = int(ends[stop - 1]), stop


class Joined:
    """Texts laid end to end; `row` of a byte place is found by `bounds`."""

    def __init__(self, texts: list[bytes | None]):
        raw = [t or b"" for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in bytes, and the number of each row's first word."""
        outside = separators[self.data]
        edge = np.flatnonzero(np.diff(outside.view(np.int8), prepend=np.int8(1)))
        starts, ends = edge[::2], edge[1::2]
        first = np.searchsorted(starts, np.append(self.start, len(self.data)))
        return starts, ends, first

    def word_hashes(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same after lower-casing A-Z, with a hash of each word."""
        starts, ends, first = self.words(separators)
        sums = prefix(BYTE_VALUE[LOWER[self.data]])
        return starts, ends, first, spans_hash(sums, starts, ends)


def binary(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()
