"""Vectorised word splitting and hashing over Arrow string columns.

A batch is cut into blocks of whole documents; in each block the UTF-8 bytes are
classified with a lookup table, words are maximal runs of word bytes, and a
word's hash is the sum of pseudo-random values of its (byte, offset) pairs.
All hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _SPACE
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of a block: word i of document d lies at ``first[d] + i``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(documents) + 1

    def doc(self, d: int) -> slice:
        return slice(self.first[d], self.first[d + 1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, offsets from 0, bytes) of blocks of whole documents."""
    at, data = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]]
        lo = hi


def split(at: np.ndarray, data: np.ndarray, word_bytes: np.ndarray, lower: bool = False) -> Words:
    """``at``: document offsets in ``data``, from 0."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_bytes[data]
    cut = np.zeros(n + 1, bool)  # a document begins: words never run on
    cut[at] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    first = np.searchsorted(start, at, "left")
    if len(start):
        offset = np.arange(n, dtype=np.int64)
        length = end - start
        keep = here[:n]
        offset = offset[keep] - np.repeat(start, length)
        value = _BYTE[data[keep]] + offset.astype(_U) * _U(0xD6E8FEB86659FD93)
        value ^= value >> _U(29)
        value *= _U(0x9FB21C651E98DF25)
        value ^= value >> _U(32)
        runs = np.zeros(len(start), np.int64)
        np.cumsum(length[:-1], out=runs[1:])
        hashed = mix(np.add.reduceat(value, runs) + length.astype(_U))
    else:
        hashed = np.zeros(0, _U)
    return Words(data.tobytes(), start, end, hashed, first)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(31)))
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; row i starts at word i. Rows may cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    if k == 1:
        return hashes
    half = grams(hashes, k // 2)
    whole = _join(half[: len(half) - k // 2], half[k // 2 :])
    return _join(whole[:n], hashes[k - 1 :]) if k % 2 else whole


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole word sequence."""
    place = np.arange(1, len(hashes) + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)
    return int(mix(np.add.reduce(mix(hashes + place), dtype=_U).reshape(1) + _U(len(hashes)))[0])


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(starts: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Mask of n words of which those from each start on, ``width`` of them, are set."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + width, -1)
    return np.cumsum(depth[:-1]) > 0
