"""Sorted runs of text suffixes: anchors, front coding, a prefix-aware loser tree, and what a group
of suffixes says about repeated windows.

A window is ``WINDOW`` bytes of one document.  Its anchor is the leftmost of the smallest hashes of
the ``GRAM``-byte strings inside it, so equal windows have their anchor at the same place.  An
anchor serves a stretch of consecutive windows; the bytes of all of them are its hull.  As a
suffix, the hull is written from the anchor on, followed by what precedes the anchor, reversed:

    key = text[p:hi + WINDOW] + reverse(text[lo:p])

Two windows are equal exactly if they lie at the same distance before equal anchors and both
parts agree that far, which longest common prefixes of sorted keys tell.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import xxhash

from .common import mix64, ranges
from .shingles import _powers

WINDOW = 200
GRAM = 32
_SPAN = WINDOW - GRAM + 1  # grams in a window
_B = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    width, factor = 1, _B
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width *= 2
        factor = factor * factor % (1 << 64)
    return mix64(h)


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values) - span + 1
    padded = np.full(-(-len(values) // span) * span, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1:span - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, gram hash, p, lo, hi) of the anchors of concatenated texts: p and the first and last
    window served count from the text's start."""
    if len(raw) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    grams = gram_hashes(raw)
    best = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), _SPAN)
    place = (best & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    valid = np.arange(len(place)) + WINDOW <= offsets[1:][row]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    p, r = place[lo], row[lo]
    start = offsets[r]
    return r, grams[p], p - start, lo - start, hi - start


def fold_periods(raw: np.ndarray, offsets: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Anchors in a row with equal hulls (a stretch of short period, such as one repeated byte) as
    their first one, with the distance to their last; 0 for all others."""
    row, gram, p, lo, hi = found
    step = np.diff(p)
    same = (row[1:] == row[:-1]) & (gram[1:] == gram[:-1]) & (np.diff(lo) == step) & (np.diff(hi) == step)
    at = np.flatnonzero(same)
    start = offsets[row]
    for q in np.unique(step[at]).tolist():  # equal hulls: no byte differs from the one q places on
        pairs = at[step[at] == q]
        a, b = lo[pairs] + start[pairs], hi[pairs] + start[pairs] + WINDOW
        first, end = int(a.min()), int(b.max())
        differ = np.concatenate(([0], np.cumsum(raw[first:end] != raw[first + q:end + q])))
        same[pairs] = differ[b - first] == differ[a - first]
    leader = np.flatnonzero(np.concatenate((np.ones(min(1, len(p)), bool), ~same)))
    last = np.append(leader[1:], len(p)) - 1 if len(p) else leader
    return tuple(x[leader] for x in found) + (p[last] - p[leader],)


def make_key(text: bytes, p: int, lo: int, hi: int) -> tuple[bytes, int]:
    """(key, length of its part from the anchor on)."""
    right = text[p:hi + WINDOW]
    return right + text[lo:p][::-1], len(right)


def name_of(key: bytes, right: int) -> bytes:
    """128-bit name of a hull."""
    return xxhash.xxh3_128_digest(key, seed=right)


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    return known + _mismatch(a, b)


def _mismatch(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - ((x.bit_length() + 7) >> 3)


# -- front-coded runs -----------------------------------------------------------------------


def encode_run(entries: list[tuple[bytes, int, bool]]) -> bytes:
    """A run of (key, right, several), sorted and distinct: each key without the prefix it shares
    with the one before."""
    n = len(entries)
    shared, rest, rights, several, tails = [], [], [], bytearray(n), []
    before = b""
    for i, (key, right, many) in enumerate(entries):
        h = common_prefix(before, key)
        shared.append(h)
        rest.append(len(key) - h)
        rights.append(right)
        several[i] = many
        tails.append(key[h:])
        before = key
    numbers = np.array([shared, rest, rights], "<u2").tobytes()
    return struct.pack("<I", n) + numbers + bytes(several) + b"".join(tails)


def decode_run(blob: bytes) -> Iterator[tuple[int, bytes, int, bool]]:
    """(prefix shared with the entry before, key, right, several) of a run, in order."""
    (n,) = struct.unpack_from("<I", blob)
    numbers = np.frombuffer(blob, "<u2", 3 * n, 4).reshape(3, n)
    at = 4 + 7 * n
    key = b""
    for h, rest, right, many in zip(*(x.tolist() for x in numbers), blob[4 + 6 * n:at]):
        key = key[:h] + blob[at:at + rest]
        at += rest
        yield h, key, right, bool(many)


def sort_run(entries: dict[tuple[bytes, int], bool]) -> list[tuple[bytes, int, bool]]:
    """Sorted entries of (key, right): whether it occurred more than once."""
    return [(key, right, entries[key, right]) for key, right in sorted(entries)]


def merge_runs(blobs: list[bytes]) -> Iterator[tuple[int, bytes, int, bool]]:
    """Merge of front-coded runs: (prefix shared with the entry before, key, right, several), equal
    entries joined.

    A loser tree over the runs' heads.  Every head carries the length of the prefix it shares with
    the last winner: of two heads the one that shares more is smaller, and only heads that share
    equally much are compared, from there on."""
    streams = [decode_run(b) for b in blobs]
    size = 1
    while size < len(streams):
        size *= 2
    # a head: [shared with the last winner, key, right, several, run]; an ended run has no key
    done = [-1, None, 0, False, -1]

    def head(run: int):
        got = next(streams[run], None) if run < len(streams) else None
        return [*got, run] if got else done

    def play(a, b):
        """(winner, loser); the loser's shared length becomes that with the winner."""
        if a[1] is None:
            return b, a
        if b[1] is None:
            return a, b
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y, h = a[1], b[1], a[0]
        n = min(len(x), len(y))
        if x[h:n] == y[h:n]:
            h = n
            a_first = (len(x), a[2]) <= (len(y), b[2])
        else:
            h += _mismatch(x[h:n], y[h:n])
            a_first = x[h] < y[h]
        if a_first:
            b[0] = h
            return a, b
        a[0] = h
        return b, a

    losers = [done] * size
    level = [head(i) for i in range(size)]
    for h in level:
        if h[1] is not None:
            h[0] = 0
    node = size
    while len(level) > 1:
        node //= 2
        pairs = [play(level[2 * i], level[2 * i + 1]) for i in range(len(level) // 2)]
        for i, (_, loser) in enumerate(pairs):
            losers[node + i] = loser
        level = [winner for winner, _ in pairs]
    top = level[0]
    held = None  # the entry not yet given out: [shared, key, right, several]
    while top[1] is not None:
        h, key, right, many, run = top
        if held is not None and held[2] == right and h == len(key) == len(held[1]):
            held[3] = True
        else:
            if held is not None:
                yield tuple(held)
            held = [h, key, right, many]
        challenger = head(run)
        at = (size + run) // 2
        while at:
            challenger, losers[at] = play(challenger, losers[at])
            at //= 2
        top = challenger
    if held is not None:
        yield tuple(held)


# -- repeated windows -----------------------------------------------------------------------


def window_marks(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key's index, distance before the anchor, 128-bit mark in two parts) of every window."""
    hulls = [key[right:][::-1] + key[:right] for key, right in keys]
    sizes = np.array([len(h) for h in hulls])
    raw = np.frombuffer(b"".join(hulls), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    at = ranges(start, count)
    owner = np.repeat(np.arange(len(keys)), count)
    distance = np.array([len(k) - r for k, r in keys])[owner] - (at - start[owner])
    powers, inverse = _powers(len(raw))
    marks = []
    for k in (1, 2):  # two polynomials over differently mixed bytes
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix64(raw * np.uint64(2 * k + 1)) * powers, out=prefix[1:])
        marks.append(mix64((prefix[at + WINDOW] - prefix[at]) * inverse[at]))
    return owner, distance, *marks


def repeated(group: list[tuple[int, bytes, int, bool]]) -> list[tuple[int, int, int]]:
    """(entry's index, first distance, last distance) of the repeated windows of entries with the
    same gram, in sorted order with shared prefixes."""
    out = []
    n = len(group)
    reach = [(WINDOW - right, len(key) - right) for _, key, right, _ in group]
    if n <= 8:
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i in range(n):
            h = 1 << 30
            _, x, xr, _ = group[i]
            for j in range(i + 1, n):
                h = min(h, group[j][0])
                _, y, yr, _ = group[j]
                first = max(WINDOW - min(h, xr, yr), reach[i][0], reach[j][0])
                limit = min(reach[i][1], reach[j][1])
                if first > limit:
                    continue
                last = min(limit, common_prefix(x[xr:xr + limit], y[yr:yr + limit]))
                if first <= last:
                    found[i].append((first, last))
                    found[j].append((first, last))
        for i in range(n):
            if group[i][3]:
                out.append((i, *reach[i]))
            else:
                out += [(i, a, b) for a, b in _joined(found[i])]
        return out
    parts = []
    for lo in range(0, n, 1000):  # bounds the byte-level arrays
        own, dist, x, y = window_marks([(key, right) for _, key, right, _ in group[lo:lo + 1000]])
        parts.append(((own + lo).astype(np.int32), dist.astype(np.int16), x, y))
    owner, distance, a, b = (np.concatenate(x) for x in zip(*parts))
    del parts
    many = np.array([m for *_, m in group])
    twice = many[owner]
    sizes = np.cumsum(np.bincount(distance, minlength=WINDOW + 1))
    lo = 0
    while lo <= WINDOW:  # equal windows lie at one distance: some distances at a time
        before = int(sizes[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + 200_000, side="right")))
        at = np.flatnonzero((distance >= lo) & (distance < hi))
        at = at[np.lexsort((b[at], a[at], distance[at]))]
        same = (distance[at[1:]] == distance[at[:-1]]) & (a[at[1:]] == a[at[:-1]]) & (b[at[1:]] == b[at[:-1]])
        twice[at[1:][same]] = True
        twice[at[:-1][same]] = True
        lo = hi
    owner, distance = owner[twice], distance[twice]
    at = np.lexsort((distance, owner))
    owner, distance = owner[at], distance[at]
    if not len(owner):
        return out
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (distance[1:] > distance[:-1] + 1))))
    end = np.append(new[1:], len(owner)) - 1
    return list(zip(owner[new].tolist(), distance[new].tolist(), distance[end].tolist()))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats_of(merged: Iterator[tuple[int, bytes, int, bool]]) -> Iterator[tuple[bytes, int, int]]:
    """(hull's name, first distance, last distance) of the repeated windows of a merged run."""
    group: list[tuple[int, bytes, int, bool]] = []

    def close():
        if len(group) > 1 or (group and group[0][3]):
            for i, first, last in repeated(group):
                yield name_of(group[i][1], group[i][2]), first, last

    for entry in merged:
        if group and entry[0] < GRAM:
            yield from close()
            group = []
        group.append(entry)
    yield from close()
