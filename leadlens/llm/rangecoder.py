"""Adaptive context-mixing range coder for token ids, in independently reset blocks.

A block of ids is cut into ``lanes`` equal runs.  All lanes step together (numpy over lanes) and
share one adaptive model, which starts empty in every block:

* order 2 and order 1: the id that followed this pair of ids, or this id, with a confidence;
* mixing: for each pair of confidences (and whether the two predictions agree) the weights of
  "order 2 is right", "order 1 is right" and "neither", learnt from their outcomes;
* order 0: adaptive counts of all ids, used for the share of "neither".

Each lane has a carry-less range coder of its own: 64-bit low and range, 16-bit words out.  Lane
outputs follow each other in the block's payload:

    magic "LLR1" | vocabulary u32 | ids u32 | lanes u32 | crc32 of the ids u32 | words per lane u32[lanes] | words u16[]

``decode`` checks the length and the checksum, so a damaged block is found and does not affect
the others.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import crc32_ids

MAGIC = b"LLR1"
BLOCK_IDS = 1 << 20
LANES = 4096

_U = np.uint64
_TOP, _BOTTOM, _WORD, _SHIFT = _U(1 << 48), _U(1 << 32), _U(16), _U(48)
_MASK = _U((1 << 32) - 1)
_ORDER2 = 18  # bits of the order-2 table
_SURE = 15  # highest confidence
_GUIDE = 16  # bits of the cells that a search in the cumulative counts starts from
CONTEXTS = 2 * (_SURE + 1) ** 2
_STEP = _U(24)  # what one occurrence adds to a count
_LIMIT = _U(1 << 16)


class Model:
    """Predictions for one step of all lanes; ``update`` learns the step's ids."""

    def __init__(self, vocabulary: int, lanes: int):
        # order 2, then order 1: an id and, in the lowest four bits, the confidence in it
        self.next = np.zeros((1 << _ORDER2) + vocabulary, np.int32)
        self.weights = np.ones((3, CONTEXTS), _U)  # "neither", order 2, order 1
        self.weights[0] = 2
        self.below = np.zeros((3, CONTEXTS), _U)  # weights of the outcomes before each
        self._add_up()
        self.counts = np.ones(vocabulary, _U)
        self.cumulative = np.arange(vocabulary + 1, dtype=_U)
        self.guide: tuple | None = None  # of the cumulative counts, see ``find``
        self.unseen: list[np.ndarray] = []  # ids not yet in the counts
        self.last1, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.wait = 1

    def _add_up(self) -> None:
        self.below[1] = self.weights[0]
        np.add(self.weights[0], self.weights[1], out=self.below[2])
        self.total = self.below[2] + self.weights[2]

    def predict(self, n: int) -> np.ndarray:
        """The weights' contexts; sets the ids that order 2 and order 1 predict."""
        at1 = self.last1[:n]
        self.at = np.concatenate((((at1 * 40503 + self.last2[:n] * 2654435761) >> 7) & ((1 << _ORDER2) - 1), at1 + (1 << _ORDER2)))
        self.entry = self.next.take(self.at)
        self.guess, self.sure = self.entry >> 4, self.entry & _SURE
        self.id2, self.id1 = self.guess[:n], self.guess[n:]
        return ((self.sure[:n] << 4 | self.sure[n:]) << 1 | (self.id2 == self.id1)).astype(np.int64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose range of cumulative counts holds the values."""
        c = self.cumulative
        if self.guide is None:
            wide = max(0, int(c[-1]).bit_length() - _GUIDE)
            cells = (int(c[-1]) >> wide) + 2
            below = np.bincount(((c[1:] - _U(1)) >> _U(wide)).astype(np.int64), minlength=cells)
            self.guide = _U(wide), np.concatenate(([0], np.cumsum(below)))  # ids that end at or before a cell's start
        wide, first = self.guide
        cell = (value >> wide).astype(np.int64)
        low, high = first.take(cell), first.take(cell + 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            lo, hi = low[open_], high[open_]
            middle = (lo + hi) >> 1
            after = c.take(middle + 1) <= value[open_]
            lo, hi = np.where(after, middle + 1, lo), np.where(after, hi, middle)
            low[open_], high[open_] = lo, hi
            open_ = open_[lo < hi]
        return low

    def update(self, ids: np.ndarray, key: np.ndarray) -> None:
        """``key``: outcome * CONTEXTS + context."""
        n = len(ids)
        self.weights += np.bincount(key, minlength=3 * CONTEXTS).reshape(3, CONTEXTS).astype(_U) * _STEP
        self._add_up()
        heavy = self.total > _LIMIT
        if heavy.any():
            self.weights[:, heavy] = (self.weights[:, heavy] >> _U(1)) + _U(1)
            self._add_up()
        both = np.concatenate((ids, ids)).astype(np.int32)
        sure = self.sure
        missed = np.where(sure > 1, (self.entry ^ sure) | (sure >> 1), both << 4 | 1)
        self.next[self.at] = np.where(self.guess == both, self.entry + (sure < _SURE), missed)
        self.unseen.append(ids)
        if len(self.unseen) >= self.wait:  # order 0 learns after 1, 2, 3, ... up to 8 steps
            self.counts += np.bincount(np.concatenate(self.unseen), minlength=len(self.counts)).astype(_U) * _STEP
            np.cumsum(self.counts, out=self.cumulative[1:])
            self.unseen, self.wait, self.guide = [], min(self.wait + 1, 8), None
        self.last2[:n] = self.last1[:n]
        self.last1[:n] = ids


def _run_length(n: int, lanes: int) -> tuple[int, int]:
    """(steps, lanes in use) for n ids: short blocks take fewer lanes, of 64 ids at least."""
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    return steps, -(-n // steps)


def _narrow(low, span, cumulative, count, total):
    share = span // total
    return low + cumulative * share, count * share


def _settle(low: np.ndarray, span: np.ndarray, at: np.ndarray | None = None):
    """Lanes (indices; among ``at``, if given) that must shift out a word, their range fixed if
    too small."""
    lo, sp = (low, span) if at is None else (low[at], span[at])
    same = (lo ^ (lo + sp)) < _TOP
    due = np.flatnonzero(same | (sp < _BOTTOM))
    if not len(due):
        return due
    tight = due[~same[due]]
    found = due if at is None else at[due]
    if len(tight):
        tight = tight if at is None else at[tight]
        span[tight] = (_U(0) - low[tight]) & _MASK
    return found


def encode(ids: np.ndarray, vocabulary: int, lanes: int = LANES) -> bytes:
    """Payload of one block; ids must lie below ``vocabulary``."""
    n = len(ids)
    if n and int(ids.max()) >= vocabulary:
        raise ValueError("an id lies outside the vocabulary")
    crc = crc32_ids(ids)
    if n == 0:
        return MAGIC + struct.pack("<4I", vocabulary, 0, 0, crc)
    steps, lanes = _run_length(n, lanes)
    grid = np.zeros(steps * lanes, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps  # ids of the last lane
    model = Model(vocabulary, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    words, used = np.zeros((4 * steps + 4, lanes), np.uint16), np.zeros(lanes, np.int64)

    def shift(lo: np.ndarray, sp: np.ndarray, rows: np.ndarray | None) -> None:
        at = _settle(lo, sp)
        while len(at):
            lane = at if rows is None else rows[at]
            words[used[lane], lane] = (lo[at] >> _SHIFT).astype(np.uint16)
            used[lane] += 1
            lo[at] <<= _WORD
            sp[at] <<= _WORD
            at = _settle(lo, sp, at)  # one word is enough for most

    for step in range(steps):
        m = lanes if step < last else lanes - 1
        now = grid[step, :m].astype(np.int64)
        context = model.predict(m)
        hit2 = model.id2 == now
        hit1 = (model.id1 == now) & ~hit2
        key = context + hit2 * CONTEXTS + hit1 * (2 * CONTEXTS)
        lo, sp = _narrow(low[:m], span[:m], model.below.take(key), model.weights.take(key), model.total.take(context))
        shift(lo, sp, None)
        miss = np.flatnonzero(~(hit2 | hit1))
        if len(miss):
            sym = now[miss]
            c = model.cumulative
            begin = c[sym]
            mlo, msp = _narrow(lo[miss], sp[miss], begin, c[sym + 1] - begin, c[-1])
            shift(mlo, msp, miss)
            lo[miss], sp[miss] = mlo, msp
        low[:m], span[:m] = lo, sp
        model.update(now, key)
    final = low + _MASK  # its upper 32 bits name a value inside the range
    rows = np.arange(lanes)
    words[used, rows] = (final >> _SHIFT).astype(np.uint16)
    words[used + 1, rows] = ((final >> _U(32)) & _U(0xFFFF)).astype(np.uint16)
    used += 2
    longest = int(used.max())
    body = np.ascontiguousarray(words[:longest].T)[np.arange(longest) < used[:, None]]
    return MAGIC + struct.pack("<4I", vocabulary, n, lanes, crc) + used.astype("<u4").tobytes() + body.astype("<u2").tobytes()


def decode(payload: bytes) -> np.ndarray:
    """The block's ids; ValueError if the payload is damaged."""
    if payload[:4] != MAGIC or len(payload) < 20:
        raise ValueError("not a block of ids")
    vocabulary, n, lanes, crc = struct.unpack_from("<4I", payload, 4)
    if n == 0:
        return np.zeros(0, np.uint32)
    used = np.frombuffer(payload, "<u4", lanes, 20).astype(np.int64)
    body = np.frombuffer(payload, "<u2", -1, 20 + 4 * lanes)
    if len(body) != used.sum():
        raise ValueError("a block of ids has lost data")
    steps = -(-n // lanes)
    last = n - (lanes - 1) * steps
    ends = np.cumsum(used)
    at = ends - used
    body = np.append(body, np.zeros(8, np.uint16))  # a lane's end reads as zeros
    model = Model(vocabulary, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    code = np.zeros(lanes, _U)
    out = np.zeros((steps, lanes), np.uint32)

    def pull(lane: np.ndarray) -> np.ndarray:
        here = at[lane]
        at[lane] = here + 1
        return np.where(here < ends[lane], body.take(here, mode="clip"), 0).astype(_U)

    def shift(lo, sp, co, rows) -> None:
        i = _settle(lo, sp)
        while len(i):
            co[i] = (co[i] << _WORD) | pull(i if rows is None else rows[i])
            lo[i] <<= _WORD
            sp[i] <<= _WORD
            i = _settle(lo, sp, i)

    everyone = np.arange(lanes)
    for _ in range(4):
        code = (code << _WORD) | pull(everyone)
    for step in range(steps):
        m = lanes if step < last else lanes - 1
        context = model.predict(m)
        lo, sp, co = low[:m], span[:m], code[:m]
        share = sp // model.total.take(context)
        value = co - lo  # compared with the bounds' products, which spares a division
        hit1 = value >= model.below[2].take(context) * share
        hit2 = (value >= model.below[1].take(context) * share) & ~hit1
        key = context + hit2 * CONTEXTS + hit1 * (2 * CONTEXTS)
        lo = lo + model.below.take(key) * share
        sp = model.weights.take(key) * share
        co = co.copy()
        shift(lo, sp, co, None)
        now = np.where(hit2, model.id2, model.id1).astype(np.int64)
        miss = np.flatnonzero(~(hit2 | hit1))
        if len(miss):
            c = model.cumulative
            mlo, msp, mco = lo[miss], sp[miss], co[miss]
            value = (mco - mlo) // (msp // c[-1])
            sym = model.find(np.minimum(value, c[-1] - _U(1)))
            begin = c[sym]
            mlo, msp = _narrow(mlo, msp, begin, c[sym + 1] - begin, c[-1])
            shift(mlo, msp, mco, miss)
            lo[miss], sp[miss], co[miss] = mlo, msp, mco
            now[miss] = sym
        low[:m], span[:m], code[:m] = lo, sp, co
        out[step, :m] = now
        model.update(now, key)
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n]
    if crc32_ids(ids) != crc:
        raise ValueError("a block of ids is damaged")
    return ids
