"""Word shingles as 64-bit hashes, computed on the bytes of whole slices of texts.

Words are runs of bytes other than blank and \\t \\n \\v \\f \\r, with A-Z lower-cased.  A word's
hash is a polynomial over its bytes, taken from prefix sums (arithmetic modulo 2**64, odd base,
so that a prefix can be divided out again); a shingle's hash combines the hashes of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, utf8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.ones(1, np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = tuple(np.cumprod(np.concatenate((_ONE, np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        _POWERS[0] = have
    return have[0][:n], have[1][:n]


BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII characters but letters and digits.
SIGNS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(array: pa.Array, between: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) of a null-free string array;
    ``between`` marks the bytes that part words."""
    raw, offsets = utf8(array)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(array) + 1, np.int64)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + (upper.astype(np.uint8) << 5)
    inside = np.ones(len(raw) + 2, bool)
    inside[[0, -1]] = False
    inside[1:-1] = ~between[raw]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] |= inside[1:-1][cuts]  # a text's end ends its word
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverse = _powers(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _BASE), np.searchsorted(starts, offsets)


def shingles(array: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text): the ``size``-word shingles of each text in order, repeats
    included; a text of fewer words has its whole sequence as one; a text without words none."""
    word, at = words(array)
    counts = np.diff(at)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(int(offsets[-1]), np.uint64)
    long = np.repeat(counts >= size, n)
    position = np.arange(len(out)) - np.repeat(offsets[:-1], n) + np.repeat(at[:-1], n)
    padded = np.concatenate((word, np.zeros(size, np.uint64)))
    width = np.where(long, size, np.repeat(counts, n))
    for j in range(size):
        here = mix64(padded[position + j] + np.uint64((j + 1) * 0xD1B54A32D192ED03 & ((1 << 64) - 1)))
        out += here if len(out) and bool(np.all(width > j)) else np.where(width > j, here, np.uint64(0))
    return mix64(out + width.astype(np.uint64)), offsets


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending, and the offsets."""
    ordered = hashes.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ordered[a:b].sort()
    keep = np.ones(len(ordered), bool)
    keep[1:] = ordered[1:] != ordered[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = True
    return ordered[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
