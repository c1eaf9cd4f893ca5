"""Vectorised words of UTF-8 texts: runs of bytes other than \\x20 and \\x09-\\x0D, as 64-bit hashes.

Every text is taken whole. Work goes in chunks of whole texts of about
``CHUNK`` bytes, so memory follows the longest text, never the table.
A word's hash depends on its bytes alone, so hashes agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    """Words of a run of texts: hash, text index, first byte and the byte after the last."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64 bits with good avalanche."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK * 2)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """data: bytes of the texts; offsets: n + 1 places in data. A text without words gives none."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, z)
    if lower:
        data = LOWER[data]
    solid = ~SPACES[data]
    first, last = offsets[:-1], offsets[1:]
    some = last > first
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[first[some]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[last[some] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start]
        h = mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))
    return Words(h, np.searchsorted(offsets, start, "right") - 1, start, end)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and offsets; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.DictionaryArray):
        col = col.dictionary_decode()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    col = col.cast(pa.large_binary()) if large else col.cast(pa.binary())
    if col.null_count:
        col = col.fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offs, kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, their bytes, their offsets): whole texts of about size bytes together."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def blocks_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The block, of n (a power of two), of each key: its upper bits."""
    return (keys >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(keys), np.int64)


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        k, c = np.unique(keys, return_counts=True)
        return k, c.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c.astype(np.int64), first)
