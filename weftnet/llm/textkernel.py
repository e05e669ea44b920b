"""NumPy kernels over the bytes of an Arrow string array.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Its hash is
a polynomial over per-byte random values modulo 2**64, mixed at the end; it
depends on the word alone, so equal words have equal hashes in any batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
GOLDEN = 0x9E3779B97F4A7C15
_RADIX = 0xD1342543DE82EF95  # odd
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in a new array)."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def odd(k: int) -> np.uint64:
    """The k-th of a fixed sequence of unrelated odd multipliers (sums of one choice of them are no sums of another)."""
    return mix(np.full(1, (GOLDEN * (k + 1)) % 2**64, np.uint64))[0] | np.uint64(1)


def _byte_values(lower: bool) -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
    if lower:
        out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[SPACES] = 0
    return out


VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_powers: dict[int, np.ndarray] = {}


def _power(radix: int, n: int) -> np.ndarray:
    have = _powers.get(radix)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), radix, np.uint64)
        have[0] = 1
        _powers[radix] = have = np.cumprod(have)
    return have[:n]


class Words(NamedTuple):
    """Words of some documents: hashes, byte ranges in ``data``, first word of each document (and the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of_doc: np.ndarray
    data: np.ndarray


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts and where each begins (and the end). Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, from one start to the next; bytes of value 0 don't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    each = values[data]
    each *= _power(_RADIX, len(data))
    hashes = np.add.reduceat(each, starts)
    hashes *= _power(pow(_RADIX, -1, 2**64), len(data))[starts]
    return mix(hashes)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = bytes_of(texts)
    solid = ~SPACES[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a text's start breaks a word, too
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hashes(data, starts, VALUES[lower])
    return Words(hashes, starts, ends, np.searchsorted(starts, at), data)


def run_hashes(sums: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` values from each begin on; ``sums``: as made by ``running``."""
    return mix((sums[begins + length] - sums[begins]) * _power(pow(_RADIX, -1, 2**64), len(sums))[begins])


def running(values: np.ndarray) -> np.ndarray:
    """Sums from which ``run_hashes`` takes the hash of any run of non-negative values."""
    each = mix((values.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)) | np.uint64(1)
    out = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each * _power(_RADIX, len(each)), out=out[1:])
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, those across documents included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size * GOLDEN % 2**64), np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * odd(k)
    return mix(out)


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    _, at = bytes_of(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most_bytes, "right")) - 1)
        yield begin, min(end, len(texts))
        begin = end


def packed(groups: np.ndarray, columns: list[np.ndarray], n_groups: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each group number that occurs: its rows of the columns as bytes."""
    order = np.argsort(groups, kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(groups[order], np.arange(n_groups + 1))
    for g in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(g), [c[cuts[g] : cuts[g + 1]].tobytes() for c in columns]
