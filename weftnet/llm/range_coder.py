"""Adaptive context-mixing range coder for token ids below 2**16.

Ids are cut into blocks of ``block`` ids. Every block starts from the same empty
model and has its own code and its own CRC-32; a chunk's head holds only where
each block's code ends and what its checksum is. ``decode_block`` reads and checks
one block whatever has become of the others. ``encode`` and ``decode`` handle the
blocks of a chunk side by side, as NumPy lanes.

The model of the next id, all of it learned inside the block:

* order 2 and order 1: the id that last followed the two ids before, or the one
  before, with a confidence of 1 to 3 (0: none yet). Per order and confidence the
  block learns how often that is right.
* order 0: how often each id has occurred in the block. The counts are taken
  anew at each power of two of ids from ``FIRST`` on; the block learns how often
  an id that both contexts missed is among those counted.
* ids new to the block: a fixed prior that falls with the id, as ids of byte-pair
  vocabularies are given by rank (``prior``).

They are mixed to one interval of 2**30: a part for the order-2 prediction in
proportion to its learned success, of the rest a part for the order-1
prediction, of that rest a part for the order-0 counts, and the remainder for the
prior. A carry-less range coder of 64 bits, which emits 16 bits at a time, codes
the interval. All arithmetic is on integers, so code is portable.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
FIRST = 32  # ids before the first counts
SLOTS = 10  # 2**SLOTS contexts an order and block
TOTAL = 30
U = np.uint64
WHOLE, TOP, BOTTOM, LOW = U(1 << TOTAL), U(1 << 48), U(1 << 40), U(16)
RATE = 5
# of 65536: what orders 2, 1 and 0 start from, by confidence, and stay between (for order 0, 1 is the only confidence)
START = np.array([[64, 20000, 35000, 50000]] * 2 + [[0, 32768, 0, 0]], np.int32)
LEAST, MOST = np.array([[32], [32], [2048]], np.int32), np.array([[60000], [60000], [63488]], np.int32)
PRIOR_BITS = 17
STRIP = 64  # steps whose intervals are found at once
MAGIC = b"WTC2"


class BadBlock(ValueError):
    """A block's ids don't match its checksum, or a chunk's head is damaged."""


def prior() -> np.ndarray:
    """Where each id's share of 2**17 begins (and the end): one each, and as much again dealt evenly to octaves of ids."""
    x = np.arange((1 << 16) + 1, dtype=np.int64)
    octave = np.zeros(len(x), np.int64)
    for k in range(1, 17):
        octave[1 << k :] = k
    inside = (x - (1 << octave)) * 4096 >> octave
    return (x + np.where(x > 0, np.minimum(octave * 4096 + inside, 65536), 0)).astype(U)


PRIOR = prior()
#: The id of each share of the prior.
_PRIOR_ID = np.repeat(np.arange(1 << 16, dtype=np.uint16), np.diff(PRIOR).astype(np.int64))


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the order-2 and order-1 contexts."""
    one, mask = last * 40503 >> 3, (1 << SLOTS) - 1
    return one + (before * 2654435761 >> 7) & mask, one & mask


class Shares:
    """How often each order was right, by confidence, for some lanes at once. Rows: order 2, 1, 0."""

    def __init__(self, lanes: int):
        self.level = np.arange(3 * lanes, dtype=np.int64).reshape(3, lanes) << 2
        self.success = np.repeat(START, lanes, axis=0).reshape(-1)
        self.third = self.level[2] + 1

    def now(self, sure: np.ndarray) -> np.ndarray:
        """Of 65536, given the confidences of orders 2 and 1."""
        self.kind = self.level.copy()
        self.kind[:2] += sure
        self.kind[2] = self.third
        self.p = self.success[self.kind]
        return self.p

    def learn(self, hits: np.ndarray, counted: np.ndarray | None) -> None:
        """``hits`` (3, lanes); ``counted``: lanes in which order 0 was asked."""
        p = self.p - (self.p >> RATE)
        p += hits * np.int32(65536 >> RATE)
        np.maximum(p, LEAST, out=p)
        np.minimum(p, MOST, out=p)
        if counted is None:
            self.success[self.kind[:2]] = p[:2]
        else:
            self.kind[2] -= ~counted  # what isn't learned goes to a place that isn't read
            self.success[self.kind] = p


def _parts(p: np.ndarray, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the parts of orders 2, 1 and 0 of the interval."""
    share = p.astype(U)
    a = share[..., 0, :] << U(TOTAL - 16)
    b = a + ((WHOLE - a) * share[..., 1, :] >> LOW)
    return a, b, b + ((WHOLE - b) * share[..., 2, :] >> LOW) if counts else b


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: where the run of equal values that each place lies in begins and ends."""
    width = rows.shape[1]
    place = np.arange(width, dtype=np.int32)
    fresh = np.ones(rows.shape, bool)
    fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
    begin = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    last = np.ones(rows.shape, bool)
    last[:, :-1] = fresh[:, 1:]
    end = np.minimum.accumulate(np.where(last, place + 1, width)[:, ::-1], axis=1)[:, ::-1]
    return begin, end


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and number, among the ids counted last, of the id at each place (number 0: not among them); laid out by step."""
    lanes, block = rows.shape
    start, number = np.zeros((block, lanes), np.uint16), np.zeros((block, lanes), np.uint16)
    some = 16  # lanes whose tables of all ids are held at once
    begins, many = np.zeros(some << 16, np.uint16), np.zeros(some << 16, np.uint16)
    for at in range(0, lanes, some):
        own = rows[at : at + some]
        base = np.arange(len(own), dtype=np.int64)[:, None] << 16
        r = FIRST
        while r < block:
            known = np.sort(own[:, :r], axis=1, kind="stable")
            begin, end = _runs(known)
            place = base + known
            begins[place], many[place] = begin, end - begin
            seek = base + own[:, r : 2 * r]
            start[r : 2 * r, at : at + some], number[r : 2 * r, at : at + some] = begins[seek].T, many[seek].T
            many[place] = 0
            r *= 2
    return start, number


def _followers(rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """By step and lane: confidence in the context's last follower, times two, and 1 if the id is that."""
    order = np.argsort(slots.astype(np.uint16), axis=1, kind="stable")
    there, ids = np.take_along_axis(slots, order, 1), np.take_along_axis(rows, order, 1)
    known = np.zeros(rows.shape, bool)
    known[:, 1:] = there[:, 1:] == there[:, :-1]
    hit = known.copy()
    hit[:, 1:] &= ids[:, 1:] == ids[:, :-1]
    sure = 1 + hit.astype(np.uint8)  # after this id
    sure[:, 1:] += hit[:, 1:] & hit[:, :-1]
    code = hit.astype(np.uint8)
    code[:, 1:] |= np.where(known[:, 1:], sure[:, :-1], 0) << 1
    out = np.empty_like(code)
    np.put_along_axis(out, order, code, 1)
    return out.T.copy()


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk: head (ends of the blocks' code, checksums), then the code of its blocks.

    The ids are known, so what the model says of each is found for whole blocks
    at once; only learning and coding go step by step.
    """
    ids = np.ascontiguousarray(ids, np.uint16)
    n = len(ids)
    if not n:
        return _chunk(0, 0, np.zeros(0, np.int64), np.zeros(0, np.uint32), b"")
    block = min(block, n)
    lanes = -(-n // block)
    crcs = np.array([zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, n, block)], np.uint32)
    rows = np.concatenate([ids, np.full(lanes * block - n, ids[-1], np.uint16)]).reshape(lanes, block)
    start, number = _counted(rows)
    codes, some = np.empty((block, 2, lanes), np.uint8), 256
    for at in range(0, lanes, some):  # a few lanes at a time bound what is held
        own = np.zeros((len(rows[at : at + some]), block + 2), np.int64)
        own[:, 2:] = rows[at : at + some]
        for k, slots in enumerate(_slots(own[:, 1:-1], own[:, :-2])):
            codes[:, k, at : at + some] = _followers(rows[at : at + some], slots)
    grid, shares = rows.T, Shares(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    words = np.zeros((lanes, 2 * block + 8), np.uint16)
    flat, width = words.reshape(-1), words.shape[1]
    at = np.arange(lanes, dtype=np.int64) * width
    edges = sorted({*range(0, block, STRIP), min(FIRST, block), block})
    for t, to in zip(edges, edges[1:]):
        bits = t.bit_length() - 1 if t >= FIRST else 0
        code = codes[t:to]
        hits = np.zeros((to - t, 3, lanes), bool)
        hits[:, :2] = code & 1
        is2, is1 = hits[:, 0], hits[:, 1] & ~hits[:, 0]
        sure, missed, among = code >> 1, ~(is1 | is2), number[t:to] > 0
        hits[:, 2] = among
        p = np.empty((to - t, 3, lanes), np.int32)
        for k in range(to - t):
            p[k] = shares.now(sure[k])
            shares.learn(hits[k], missed[k] if bits else None)
        a, b, c = _parts(p, bits > 0)
        now, rest = grid[t:to].astype(np.int32), WHOLE - c
        begin, end = c + (rest * PRIOR[now] >> U(PRIOR_BITS)), c + (rest * PRIOR[now + 1] >> U(PRIOR_BITS))
        if bits:
            first, part, by = start[t:to].astype(U), c - b, U(bits)
            np.copyto(begin, b + (part * first >> by), where=among), np.copyto(end, b + (part * (first + number[t:to]) >> by), where=among)
        np.copyto(begin, a, where=is1), np.copyto(end, b, where=is1)
        np.copyto(begin, U(0), where=is2), np.copyto(end, a, where=is2)
        end -= begin
        for k in range(to - t):
            span >>= U(TOTAL)
            low += begin[k] * span
            span *= end[k]
            while True:
                move = _moves(low, span)
                if not len(move):
                    break
                word = low[move]
                flat[at[move]] = word >> U(48)
                at[move] += 1
                low[move] = word << LOW
                span[move] <<= LOW
    for _ in range(4):
        flat[at] = low >> U(48)
        at += 1
        low = low << LOW
    used = at - np.arange(lanes) * width
    keep = np.arange(width) < used[:, None]
    return _chunk(n, block, used, crcs, words[keep].astype("<u2").tobytes())


def _moves(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose first 16 bits are settled; a span that got short is cut so that they are."""
    same = (low ^ (low + span)) < TOP
    short = span < BOTTOM
    if short.any():
        short &= ~same
        np.copyto(span, (~low + U(1)) & (BOTTOM - U(1)), where=short)
        same |= short
    return np.flatnonzero(same)


def _chunk(n: int, block: int, used: np.ndarray, crcs: np.ndarray, code: bytes) -> bytes:
    head = struct.pack("<4sIII", MAGIC, n, block, len(used)) + np.cumsum(used).astype("<u4").tobytes() + crcs.astype("<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + code


def _head(chunk: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ids a block, where each block's code ends (first: 0), checksums, all code; BadBlock if the head is damaged."""
    if len(chunk) < 20 or chunk[:4] != MAGIC:
        raise BadBlock("no chunk of this format")
    n, block, lanes = struct.unpack_from("<III", chunk, 4)
    size = 16 + 8 * lanes
    if len(chunk) < size + 4 or struct.unpack_from("<I", chunk, size)[0] != zlib.crc32(chunk[:size]):
        raise BadBlock("the head is damaged")
    ends = np.concatenate([[0], np.frombuffer(chunk, "<u4", lanes, 16).astype(np.int64)])
    code = np.frombuffer(chunk, "<u2", (len(chunk) - size - 4) // 2, size + 4)
    return n, block, ends, np.frombuffer(chunk, "<u4", lanes, 16 + 4 * lanes), code


def _steps(n: int, block: int, lanes: int) -> int:
    """Ids of each lane; a last block that is alone may be cut short."""
    return block if lanes > 1 else min(n, block)


def _decoded(code: list[np.ndarray], steps: int) -> np.ndarray:
    """Ids of some blocks (lanes, steps), from the code of each."""
    lanes = len(code)
    words = np.zeros((lanes, max(map(len, code)) + 4), U)
    for k, x in enumerate(code):
        words[k, : len(x)] = x
    flat, width = words.reshape(-1), words.shape[1]
    at = np.arange(lanes, dtype=np.int64) * width
    last = at + width - 1
    value = np.zeros(lanes, U)
    for _ in range(4):
        value = value << LOW | flat[at]
        at += 1
    low, span = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    shares, out = Shares(lanes), np.zeros((steps, lanes), np.uint16)
    table = np.zeros(2 * lanes << SLOTS, np.uint32)  # last follower << 2 | confidence
    base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) << SLOTS
    before = previous = np.zeros(lanes, np.int64)
    bits, lane, hits = 0, np.arange(lanes, dtype=np.int64), np.zeros((3, lanes), bool)
    for t in range(steps):
        if t >= FIRST and not t & t - 1:
            bits = t.bit_length() - 1
            known = np.sort(out[:t].T, axis=1, kind="stable")
            begins, ends = (x.astype(np.uint16).reshape(-1) for x in _runs(known))
            known, shift = known.reshape(-1), lane << bits
        place = np.stack(_slots(previous, before)) + base
        seen = table[place]
        sure = seen & 3
        named = seen >> 2
        a, b, c = _parts(shares.now(sure), bits > 0)
        span >>= U(TOTAL)
        to = np.minimum((value - low) // span, WHOLE - U(1))
        is2, is1 = to < a, (to >= a) & (to < b)
        begin, end, now = np.where(is2, U(0), a), np.where(is2, a, b), np.where(is2, named[0], named[1]).astype(np.uint16)
        among = None
        if bits:
            among = (to >= b) & (to < c)
            k = np.flatnonzero(among)
            low0, part, by = b[k], c[k] - b[k], U(bits)
            # the last of the counted that begins at or below it
            spot = ((((to[k] - low0 + U(1)) << by) - U(1)) // part).astype(np.int64) + shift[k]
            now[k], begin[k], end[k] = known[spot], low0 + (part * begins[spot] >> by), low0 + (part * ends[spot] >> by)
        k = np.flatnonzero(to >= c)
        low0 = c[k]
        rest = WHOLE - low0
        new = _PRIOR_ID[(((to[k] - low0 + U(1)) << U(PRIOR_BITS)) - U(1)) // rest]
        now[k], begin[k], end[k] = new, low0 + (rest * PRIOR[new] >> U(PRIOR_BITS)), low0 + (rest * PRIOR[new.astype(np.int32) + 1] >> U(PRIOR_BITS))
        low += begin * span
        span *= end - begin
        while True:
            move = _moves(low, span)
            if not len(move):
                break
            low[move] <<= LOW
            span[move] <<= LOW
            value[move] = value[move] << LOW | flat[np.minimum(at[move], last[move])]
            at[move] += 1
        hits[:2] = (named == now) & (sure > 0)
        if bits:
            hits[2] = among
        shares.learn(hits, ~(is1 | is2) if bits else None)
        table[place] = np.where(hits[:2], seen + (sure < 3), now.astype(np.uint32) << np.uint32(2) | np.uint32(1))
        before, previous = previous, now.astype(np.int64)
        out[t] = now
    return out.T


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk as uint16; BadBlock if a checksum doesn't match."""
    n, block, ends, crcs, code = _head(chunk)
    if not n:
        return np.zeros(0, np.uint16)
    lanes = len(crcs)
    ids = _decoded([code[ends[k] : ends[k + 1]] for k in range(lanes)], _steps(n, block, lanes)).reshape(-1)[:n]
    for k in range(lanes):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != crcs[k]:
            raise BadBlock(f"block {k} doesn't match its checksum")
    return ids


def decode_block(chunk: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` of a chunk alone; the other blocks' code isn't read. BadBlock if its checksum doesn't match."""
    n, block, ends, crcs, code = _head(chunk)
    if not 0 <= k < len(crcs):
        raise IndexError(f"block {k} of {len(crcs)}")
    ids = _decoded([code[ends[k] : ends[k + 1]]], _steps(n, block, len(crcs)))[0][: n - k * block]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crcs[k]:
        raise BadBlock(f"block {k} doesn't match its checksum")
    return ids
