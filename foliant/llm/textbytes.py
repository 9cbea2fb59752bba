"""Vectorised work on the UTF-8 bytes of Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A random odd base, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept for the next call."""
    known = _powers[base]
    if len(known) < n:
        factors = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        factors[0] = 1
        known = _powers[base] = np.multiply.accumulate(factors)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i] is the polynomial hash of data[:i], with data[j] + 1 the coefficient of BASE**j."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that don't depend on where the span lies."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


@dataclass(frozen=True)
class Block:
    """Whole texts, one behind the other: text i is data[bounds[i]:bounds[i + 1]], row first + i of its batch."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + len(self.bounds) - 1)

    def __len__(self) -> int:
        return len(self.bounds) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A string column as blocks of about ``limit`` bytes; a longer text is a block by itself, a null one is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Block(at, raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Separators of words: white space of ASCII (0x09 to 0x0D, and the space).
WHITE = byte_class(bytes([*range(0x09, 0x0E), 0x20]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text of the block
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i


def words(block: Block, separators: np.ndarray = WHITE) -> Words:
    """Maximal runs of bytes that are no separators; no word spans two texts."""
    inside = ~separators[block.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[block.bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, block.bounds)
    text = np.repeat(np.arange(len(block)), np.diff(first))
    return Words(starts, ends, text, first)
