"""Words of Arrow text columns as 64-bit hashes, in numpy.

A chunk of texts is one byte array.  Each byte is mapped by a table (0: not in
a word), and a running sum of the bytes' random values times powers of an odd
base, modulo 2**64, gives the hash of any word as a difference times an inverse
power: no Python object for a word is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
U = np.uint64


@cache
def _values() -> np.ndarray:
    out = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    out[0] = 0
    return out


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, CHUNK + (1 << 18))
        each = np.full(size, BASE, np.uint64)
        each[0] = 1
        _POWERS = np.multiply.accumulate(each)
        each[1:] = U(pow(BASE, -1, 1 << 64))
        _INVERSE = np.multiply.accumulate(each)
    return _POWERS, _INVERSE


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def split_table(kind: str) -> np.ndarray:
    """A byte's value in words, 0 outside.  ``spaced``: all but ASCII white space; ``alnum``: digits, letters and bytes over 127.  A-Z are lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    out = [*range(9, 14), 32] if kind == "spaced" else [*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]
    table[out] = 0
    if kind == "spaced":
        table[0] = 255  # the null sign is in words; 255 is no byte of UTF-8
    return table


@dataclass
class Chunk:
    """Some consecutive texts of a batch: their bytes, where each begins and ends, and the batch row of the first."""

    data: np.ndarray
    bounds: np.ndarray
    row: int


@dataclass
class Words:
    hashes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    #: index of each text's first word, and the number of words at the end
    first: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole texts of about ``size`` bytes; a longer text is a chunk of its own."""
    data, bounds = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        to = min(to, n)
        yield Chunk(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at)
        at = to


def words(chunk: Chunk, table: np.ndarray) -> Words:
    """The words of a chunk and their hashes."""
    n = len(chunk.data)
    shown = table[chunk.data]
    inside = np.zeros(n + 1, bool)
    inside[:n] = shown != 0
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else begins[1:]
    edges = chunk.bounds[1:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]  # a text's first word
    starts = np.flatnonzero(begins)
    ends = inside[:n] & ~inside[1:]
    last = chunk.bounds[1:]
    last = last[last > 0] - 1
    ends[last] = inside[last]
    stops = np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[shown] * up[:n], out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return Words(hashes, starts, stops, np.searchsorted(starts, chunk.bounds))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; it may run over a text's end."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for k in range(1, n):
        out = (out ^ (out >> U(32))) * U(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return mixed(out)
