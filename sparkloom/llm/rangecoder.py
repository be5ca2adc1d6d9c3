"""Context-mixing range coder of token ids, in lockstep over independently reset blocks.

A chunk of ids has one ``Statistics``: frequencies of its ids (order 0) and,
for its most frequent ids, of what follows them (order 1). They are stored
with the chunk. Each block of ``BLOCK`` ids is then coded on its own, and
learns as it goes: a table of what followed the last two ids when they were
last met (order 2, with a confidence), and the weights by which the three
predictions are mixed, in contexts of that confidence and of how much the
order-1 frequencies cover.

An id is coded as one of three outcomes, each with its weight: the order-2
prediction; an id of the order-1 distribution; an id of the order-0
distribution. A carryless range coder with 64-bit bounds codes them. All
blocks of a chunk are coded together, one id of each block at a time, by array
operations.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np

BLOCK = 1024
#: Slots of a block's order-2 table.
SLOTS = 1024
#: Bits of order-0 and order-1 frequencies and of mixture weights (kept with 16), and how fast weights adapt.
FREQ0, FREQ1, MIX, RATE = 18, 10, 10, 4
#: Most ids that have an order-1 distribution, occurrences that this takes, and most ids that a distribution ranges over.
HEADS, HEAD_LEAST, FOLLOWERS = 512, 400, 2048
_ONE, _MIX_ONE, _TOTAL = 1 << 16, 1 << MIX, MIX + FREQ0
_LOW32, _S32, _U1 = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(1)
#: Classes of coverage, and mixture contexts: coverage and order-2 confidence (0 to 3).
_COVERS = 5
_CONTEXTS = _COVERS * 4


class Corrupt(ValueError):
    """Coded data that is damaged."""


def _scaled(counts: np.ndarray, group: np.ndarray, groups: int, bits: int, least: int) -> np.ndarray:
    """Frequencies of ``2**bits`` a group, each ``least`` or more, in proportion to counts; what is left goes to the largest.

    With ``least`` 0 the counts must be large enough to get one themselves.
    """
    if not len(counts):
        return counts
    members, total = np.bincount(group, minlength=groups), np.bincount(group, counts, groups)
    room = (1 << bits) - least * members
    freq = least + np.floor(counts * room[group] / total[group]).astype(np.int64)
    spare = (1 << bits) - np.bincount(group, freq, groups).astype(np.int64)
    order = np.lexsort((-counts, group))
    first = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]
    freq[first] += spare[group[first]]
    return freq


class Statistics:
    """Order-0 and order-1 frequencies of a chunk.

    ``ids`` are the distinct ids, most frequent first, ``freq`` their
    frequencies; the first ``len(many)`` of them have order-1 distributions of
    ``many`` followers each: ``who`` (places in ``ids``) with frequencies ``how``.
    """

    def __init__(self, ids: np.ndarray, freq: np.ndarray, many: np.ndarray, who: np.ndarray, how: np.ndarray):
        self.ids, self.freq, self.many, self.who, self.how = ids, freq, many, who, how

    @classmethod
    def of(cls, ids: np.ndarray) -> Statistics:
        counts = np.bincount(ids)
        own = np.flatnonzero(counts)
        own = own[np.argsort(-counts[own], kind="stable")]
        n = counts[own]
        freq = _scaled(n, np.zeros(len(own), np.int64), 1, FREQ0, 1)
        heads, wide = int(np.searchsorted(-n[:HEADS], -HEAD_LEAST, "right")), min(len(own), FOLLOWERS)
        place = np.full(len(counts), -1, np.int32)
        place[own[:wide]] = np.arange(wide)
        spot = place[ids]
        before, after = spot[:-1], spot[1:]
        both = (before >= 0) & (before < heads) & (after >= 0)
        pairs = np.bincount(before[both].astype(np.int64) * wide + after[both], minlength=heads * wide)
        cell = np.flatnonzero(pairs)
        head, count = cell // max(wide, 1), pairs[cell]
        use = (count << FREQ1 >= np.bincount(head, count, max(heads, 1))[head]) & (count > 1)
        cell, head, count = cell[use], head[use], count[use]
        how = _scaled(count, head, max(heads, 1), FREQ1, 0)
        return cls(own.astype(np.uint16), freq, np.bincount(head, minlength=heads)[:heads], cell % max(wide, 1), how)

    def packed(self) -> bytes:
        parts = [x.astype("<u2").tobytes() for x in (self.ids, self.many, self.who, self.how)]
        parts.insert(1, self.freq.astype("<u4").tobytes())
        return struct.pack("<III", len(self.ids), len(self.many), len(self.who)) + zlib.compress(b"".join(parts), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Statistics:
        try:
            distinct, heads, pairs = struct.unpack_from("<III", data)
            flat = zlib.decompress(data[12:])
        except (struct.error, zlib.error) as e:
            raise Corrupt(str(e)) from e
        if len(flat) != 6 * distinct + 2 * heads + 4 * pairs:
            raise Corrupt("statistics")
        ids, freq = np.frombuffer(flat, "<u2", distinct), np.frombuffer(flat, "<u4", distinct, 2 * distinct).astype(np.int64)
        at = 6 * distinct
        many, who, how = (np.frombuffer(flat, "<u2", n, at + 2 * skip).astype(np.int64) for n, skip in ((heads, 0), (pairs, heads), (pairs, heads + pairs)))
        out = cls(ids, freq, many, who, how)
        if (distinct and freq.sum() != 1 << FREQ0) or many.sum() != pairs or (pairs and who.max() >= min(distinct, FOLLOWERS)):
            raise Corrupt("statistics")
        return out

    @cached_property
    def begin0(self) -> np.ndarray:
        """By id: where its order-0 share begins."""
        out = np.zeros(1 << 16, np.uint32)
        out[self.ids] = np.cumsum(self.freq) - self.freq
        return out

    @cached_property
    def width0(self) -> np.ndarray:
        """By id: the frequency of its order-0 share."""
        out = np.zeros(1 << 16, np.uint32)
        out[self.ids] = self.freq
        return out

    @cached_property
    def slot0(self) -> np.ndarray:
        """The id at each of the ``2**FREQ0`` shares."""
        return np.repeat(self.ids, self.freq) if len(self.ids) else np.zeros(1 << FREQ0, np.uint16)

    @cached_property
    def info(self) -> np.ndarray:
        """By id, packed: its order-1 distribution (the last one is empty and stands for none), its place among
        those that distributions range over (the last one stands for others), and the first mixture context after it."""
        heads, some = len(self.many), self.ids[:FOLLOWERS]
        row, place = np.full(1 << 16, heads), np.full(1 << 16, FOLLOWERS)
        row[self.ids[:heads]] = np.where(self.many > 0, np.arange(heads), heads)
        place[some] = np.arange(len(some))
        wide = np.clip(np.floor(np.log2(np.maximum(self.many, 1)) / 2), 0, _COVERS - 2).astype(np.int64) + 1
        cover = np.append(np.where(self.many > 0, wide, 0), 0)
        return (row << 17 | place << 5 | cover[row] * 4).astype(np.uint32)

    @cached_property
    def _heads(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.many)), self.many)

    @cached_property
    def _starts(self) -> np.ndarray:
        return (np.cumsum(self.how) - self.how) - (self._heads << FREQ1)

    @cached_property
    def share1(self) -> np.ndarray:
        """By distribution and place: begin and frequency, packed; 0 where there is none."""
        out = np.zeros((len(self.many) + 1) * (FOLLOWERS + 1), np.uint32)
        out[self._heads * (FOLLOWERS + 1) + self.who] = self._starts << 16 | self.how
        return out

    @cached_property
    def slot1(self) -> np.ndarray:
        """The id at each share of each distribution."""
        out = np.zeros((len(self.many) + 1) << FREQ1, np.uint16)
        size = int(self.how.sum())
        if size:
            filled = np.flatnonzero(self.many)
            at = (filled[:, None] << FREQ1 | np.arange(1 << FREQ1)).ravel()
            if size != len(at):
                raise Corrupt("statistics")
            out[at] = np.repeat(self.ids[self.who], self.how)
        return out


class _Lanes:
    """What one block each has learned, and its bounds; both coders drive it in the same way."""

    def __init__(self, lanes: int, known: Statistics):
        self.known = known
        self.p1, self.p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.info = np.full(lanes, known.info[0], np.uint32)
        self.table, self.base = np.zeros(lanes * SLOTS, np.uint32), np.arange(lanes, dtype=np.uint32) * np.uint32(SLOTS)
        self.mix, self.base_mix = np.full(lanes * _CONTEXTS, (_ONE // 8) << 16 | _ONE * 7 // 8, np.uint32), np.arange(lanes, dtype=np.uint32) * np.uint32(_CONTEXTS)
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def predict(self, n: int) -> None:
        """Set the order-2 prediction ``q``, the order-1 distribution ``row``, and where their outcomes end, ``a`` and ``ab``."""
        p1, p2 = self.p1[:n], self.p2[:n]
        at = p1 * np.uint32(2654435761)
        at += p2 * np.uint32(2246822519)
        at >>= np.uint32(22)
        at += self.base[:n]
        self.at = at.astype(np.intp)  # what numpy indexes by, here and in update
        e = self.table.take(self.at)
        self.q, self.sure = e >> np.uint32(2), e & np.uint32(3)
        self.row = self.info[:n] >> np.uint32(17)
        self.at_mix = self.info[:n] & np.uint32(31)
        self.at_mix += self.sure
        self.at_mix += self.base_mix[:n]
        self.at_mix = self.at_mix.astype(np.intp)
        both = self.mix.take(self.at_mix)
        self.w2, self.w1 = (both >> np.uint32(16)).view(np.int32), (both & np.uint32(0xFFFF)).view(np.int32)
        self.a = self.w2 >> (16 - MIX)
        part = (_MIX_ONE - self.a) * (self.w1 >> (16 - MIX))
        part >>= MIX
        np.maximum(part, 1, out=part)
        part += self.a
        self.ab = part

    def bounds(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and width of ids ``x`` in units of 2^-_TOTAL, whether order 1 gives them, and what is known of them.

        ``hit1`` is None where that is still to be found out: if it can. Masks
        are multiplied in, which is faster than choosing by them.
        """
        known, place = self.known, x.astype(np.intp)
        info, begin, width = known.info.take(place), known.begin0.take(place), known.width0.take(place)
        share = known.share1.take(self.row * np.uint32(FOLLOWERS + 1) + ((info >> np.uint32(5)) & np.uint32(4095)))
        if hit1 is None:
            hit1 = (share > 0) & ~hit2
        other = hit1.astype(np.uint32)
        other -= np.uint32(1)  # all bits where order 1 doesn't give it
        begin &= other
        width &= other
        np.invert(other, out=other)
        share &= other
        begin += (share >> np.uint32(16)) << np.uint32(FREQ0 - FREQ1)
        width += (share & np.uint32(0xFFFF)) << np.uint32(FREQ0 - FREQ1)
        edge = self.ab + (self.a - self.ab) * hit1
        part = _MIX_ONE + (self.ab - _MIX_ONE) * hit1
        part -= edge
        part = part.view(np.uint32)
        begin *= part
        begin += edge.view(np.uint32) << np.uint32(FREQ0)
        width *= part
        rest = ~hit2
        begin *= rest
        width *= rest
        width += (self.a * hit2).view(np.uint32) << np.uint32(FREQ0)
        return begin, width, hit1, info

    def update(self, n: int, x: np.ndarray, info: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Learn the ids that came."""
        w2 = hit2 * np.int32(_ONE)
        w2 -= self.w2
        w2 >>= RATE
        w2 += self.w2
        w1 = hit1 * np.int32(_ONE)
        w1 -= self.w1
        w1 >>= RATE
        w1 *= ~hit2
        w1 += self.w1
        for w in (w2, w1):
            np.maximum(w, 128, out=w)
            np.minimum(w, _ONE - 1024, out=w)
        w2 <<= 16
        w2 |= w1
        self.mix.put(self.at_mix, w2.view(np.uint32), mode="clip")  # all places are there; this mode is the fastest
        self.sure += np.uint32(1)
        np.minimum(self.sure, np.uint32(3), out=self.sure)
        self.sure *= hit2
        self.sure |= x << np.uint32(2)
        self.table.put(self.at, self.sure, mode="clip")
        self.p2[:n], self.p1[:n], self.info[:n] = self.p1[:n], x, info

    def narrow(self, n: int, step: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take the interval; the lanes that then move on by 32 bits, with the moved-out bits, and the shift."""
        shift = step * begin
        self.low[:n] += shift
        self.span[:n] = step * size
        (lanes,) = np.nonzero(self.span <= _LOW32)
        lo, sp = self.low[lanes], self.span[lanes]
        apart = (lo ^ (lo + sp - _U1)) > _LOW32  # the bound between is as far as the interval may reach
        sp = np.where(apart, (~lo + _U1) & _LOW32, sp)
        self.low[lanes], self.span[lanes] = lo << _S32, sp << _S32
        return lanes, lo >> _S32, shift


def encode_blocks(ids: np.ndarray, known: Statistics) -> list[bytes]:
    """The coded blocks of ``ids``, unsigned 16-bit numbers that ``known`` has counted."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return []
    padded = np.zeros(count * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(count, BLOCK).T)
    tail = len(ids) - (count - 1) * BLOCK
    lanes = _Lanes(count, known)
    words, size = np.zeros((count, BLOCK + 4), np.uint32), np.zeros(count, np.int64)
    for t in range(BLOCK if count > 1 else tail):
        n = count if t < tail else count - 1
        x = columns[t, :n]
        lanes.predict(n)
        hit2 = x == lanes.q
        begin, width, hit1, info = lanes.bounds(x, hit2, None)
        moved, out, _ = lanes.narrow(n, lanes.span[:n] >> np.uint64(_TOTAL), begin, width)
        words[moved, size[moved]] = out
        size[moved] += 1
        lanes.update(n, x, info, hit2, hit1)
    words[np.arange(count), size] = (lanes.low + _LOW32) >> _S32  # a number of the interval whose other bits are 0
    return [words[i, : size[i] + 1].astype("<u4").tobytes() for i in range(count)]


def decode_blocks(blocks: list[bytes], total: int, known: Statistics) -> np.ndarray:
    """The ``total`` ids of coded blocks."""
    count = len(blocks)
    if not count:
        return np.zeros(0, np.uint16)
    words = np.zeros((count, max(map(len, blocks)) // 4 + 3), np.uint64)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 4] = np.frombuffer(b, "<u4")
    tail = total - (count - 1) * BLOCK
    lanes = _Lanes(count, known)
    gap = words[:, 0] << _S32 | words[:, 1]  # the code less the lower bound
    at, last = np.full(count, 2, np.int64), words.shape[1] - 1
    columns = np.zeros((BLOCK, count), np.uint16)
    most = np.uint64((1 << _TOTAL) - 1)
    for t in range(BLOCK if count > 1 else tail):
        n = count if t < tail else count - 1
        lanes.predict(n)
        step = lanes.span[:n] >> np.uint64(_TOTAL)
        value = np.minimum(gap[:n] // step, most).astype(np.int32)
        top = value >> FREQ0
        hit2 = top < lanes.a
        hit1 = (top < lanes.ab) & ~hit2
        edge = lanes.ab + (lanes.a - lanes.ab) * hit1
        part = _MIX_ONE + (lanes.ab - _MIX_ONE) * hit1 - edge
        slot = np.abs(value - (edge << FREQ0)) / part  # below 2^28, so the quotient's floor is exact
        slot = np.minimum(slot, (1 << FREQ0) - 1).astype(np.uint32)
        one = known.slot1.take((lanes.row << np.uint32(FREQ1)) + (slot >> np.uint32(FREQ0 - FREQ1)))
        x = known.slot0.take(slot)
        x += (one - x) * hit1  # of 16 bits, which wrap
        x = x + (lanes.q - x) * hit2
        begin, width, _, info = lanes.bounds(x, hit2, hit1)
        moved, _, shift = lanes.narrow(n, step, begin, width)
        gap[:n] -= shift
        gap[moved] = gap[moved] << _S32 | words[moved, np.minimum(at[moved], last)]
        at[moved] += 1
        columns[t, :n] = x
        lanes.update(n, x, info, hit2, hit1)
    return columns.T.reshape(-1)[:total]
