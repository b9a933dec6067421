"""A context-mixing range coder for token ids, over many blocks at once.

Every block starts anew and is coded by itself. For each id three predictions are mixed into one
distribution:

* order 2: the id that last followed the two ids before,
* order 1: the id that last followed the id before,
* order 0: all ids, by their frequencies, which are counted beforehand and kept beside the blocks
  (``Order0``); without them all ids below ``n_ids`` are alike.

The shares of the first two are learnt per block, apart for steps where both foresee the same id
and steps where they do not; the rest goes to order 0. A range coder with 64-bit ranges and 16-bit
digits codes each id in one step.

The blocks of a call are coded side by side: one step codes the next id of every block, with
arrays over the blocks. Encoder and decoder share the model, so they stay in step.

A block is: magic, number of ids, number of digits, CRC-32 of the ids as little-endian unsigned
32-bit integers, digits as big-endian unsigned 16-bit integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
MAGIC = b"idr2"
_HEADER = struct.Struct("<4sIII")

_CHOICE = 16  # bits of the shares of the predictions
_LEAST_ORDER0 = 16  # bits of the order-0 shares, if there are not too many ids
_BITS1, _BITS2 = 9, 10
_SLOT_SHIFT = np.array([[5], [3]])
_SLOT_MASK = np.array([[(1 << _BITS2) - 1], [(1 << _BITS1) - 1]])
_RATE = 5
_FEW, _MOST = 300, 65236  # the shares of 65536 stay between these, so no part is ever empty
_TURNED = 256  # steps whose ids are brought side by side at once
_BATCH = 16  # steps that the encoder looks at together
_COUNTED = 1 << 20  # ids that are counted at once
_LEAST = np.uint64(1 << 48)
_U4, _U16, _U48 = np.uint64(4), np.uint64(16), np.uint64(48)


class BlockError(ValueError):
    """A block that is cut short or does not give the ids that its checksum names."""


class Order0:
    """Order-0 shares of ``ids`` (ascending); all of them add up to ``1 << bits``.

    Behind the ids stands what an id has that was foreseen: all.
    """

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.bits = max(_LEAST_ORDER0, len(ids).bit_length() + 2)
        shares = np.asarray(shares, dtype=np.int64)
        if len(shares) != len(ids) or shares.min(initial=1) < 1 or shares.sum() != 1 << self.bits:
            raise BlockError("order-0 shares are damaged")
        self.whole = len(ids)
        self.ids = np.append(ids, 0).astype(np.int32)
        self.shares = np.append(shares, 1 << self.bits)
        self.starts = np.append(np.cumsum(shares) - shares, 0)

    @classmethod
    def counted(cls, ids: np.ndarray, counts: np.ndarray) -> Order0:
        """Every id has a share, the more the oftener it came."""
        total = 1 << max(_LEAST_ORDER0, len(ids).bit_length() + 2)
        shares = 1 + (counts * ((total - len(ids)) / counts.sum())).astype(np.int64)
        shares[counts.argmax()] += total - shares.sum()
        return cls(ids, shares)

    @classmethod
    def of(cls, ids: np.ndarray, n_ids: int) -> Order0:
        counts = np.zeros(n_ids, dtype=np.int64)
        for i in range(0, len(ids), _COUNTED):
            counts += np.bincount(ids[i : i + _COUNTED], minlength=n_ids)
        came = counts.nonzero()[0]
        return cls.counted(came, counts[came])

    @classmethod
    def even(cls, n_ids: int) -> Order0:
        return cls.counted(np.arange(n_ids), np.ones(n_ids, dtype=np.int64))

    def places(self, n_ids: int) -> np.ndarray:
        """Where each id below ``n_ids`` stands here."""
        places = np.full(n_ids, -1, dtype=np.int64)
        places[self.ids[: self.whole]] = np.arange(self.whole)
        return places

    def lookup(self) -> np.ndarray:
        """Where the id stands that has a place, for each of the places that are shared out."""
        kind = np.uint16 if self.whole <= 1 << 16 else np.int32
        return np.repeat(np.arange(self.whole, dtype=kind), self.shares[: self.whole])


class _Model:
    """The state of all blocks: what followed each context, and the shares of the predictions.

    Arrays of two rows are about order 2 and order 1.
    """

    def __init__(self, lanes: int, n_ids: int):
        self.lanes = lanes
        self.lane = lane = np.arange(lanes, dtype=np.int64)
        # small types: what all blocks look up at random should stay near the processor
        kind = np.uint16 if n_ids <= 1 << 16 else np.int32
        self.table = np.zeros((lanes << _BITS2) + (lanes << _BITS1), dtype=kind)
        self.base_slot = np.stack([lane << _BITS2, (lane << _BITS1) + (lanes << _BITS2)])
        # the shares of order 2, where the predictions differ and where they agree; then order 1
        self.share2 = np.repeat(np.array([16000, 40000], dtype=np.int64), lanes)
        self.share1 = np.full(lanes, 12000, dtype=np.int64)

    def slots(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the table holds what followed the ids that were spread to ``before``, ``last``."""
        slots = np.empty((*last.shape[:-1], 2, self.lanes), dtype=np.int64)
        np.multiply(before, 31, out=slots[..., 0, :])
        slots[..., 0, :] += last
        slots[..., 1, :] = last
        slots >>= _SLOT_SHIFT
        slots &= _SLOT_MASK
        slots += self.base_slot
        return slots

    def adapt(self, state: np.ndarray, p2: np.ndarray, hit2: np.ndarray, goals: np.ndarray) -> None:
        """Move the shares, of which ``p2`` is that of order 2 in ``state``, towards their goals,
        ``_FEW`` and more; order 1 learns nothing where order 2 has hit (-1)."""
        goals += _FEW
        goals[0] -= p2
        goals[1] -= self.share1
        goals >>= _RATE
        goals[0] += p2
        self.share2[state] = goals[0]
        goals[1] &= ~hit2
        self.share1 += goals[1]


def _spread(ids: np.ndarray) -> np.ndarray:
    return ids * np.int64(40503)


def _part1(p2: np.ndarray, p1: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """The part of order 1 in 65536: its share of what order 2 leaves."""
    f1 = 65536 - p2
    f1 *= p1
    f1 >>= 16
    f1 *= ~agree
    return f1


class _Encoder:
    def __init__(self, lanes: int, bits: int):
        self.lanes, self.bits = lanes, np.uint64(bits)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
        self.at = self.lane.copy()  # where a block's next digit goes
        self.digits = np.zeros(256 * lanes, dtype=np.uint32)

    def narrow(self, start: np.ndarray, width: np.ndarray) -> None:
        unit = self.range >> self.bits
        low = self.low + unit * start
        carry = (low < self.low).nonzero()[0]
        if len(carry):
            self.digits[self.at[carry] - self.lanes] += 1
        unit *= width
        # most blocks write a digit; the place of the others is written again by their next one
        short = (unit < _LEAST).astype(np.uint64)
        self.digits[self.at] = low >> _U48
        self.at += short.view(np.int64) * self.lanes
        short <<= _U4
        low <<= short
        unit <<= short
        self.low, self.range = low, unit
        some = (unit < _LEAST).nonzero()[0]
        while len(some):
            some = self._shift(some)

    def _shift(self, some: np.ndarray) -> np.ndarray:
        """Write a digit of some blocks; returns those that need another one."""
        low, at = self.low.take(some), self.at.take(some)
        self.digits[at] = low >> _U48
        self.at[some] = at + self.lanes
        self.low[some] = low << _U16
        short = self.range.take(some) << _U16
        self.range[some] = short
        return some[short < _LEAST]

    def room(self, steps: int) -> None:
        need = int(self.at.max(initial=0)) + (4 * steps + 5) * self.lanes
        if need > len(self.digits):
            rows = max(need, len(self.digits) * 3 // 2) // self.lanes + 1
            grown = np.zeros(rows * self.lanes, dtype=np.uint32)
            grown[: len(self.digits)] = self.digits
            self.digits = grown

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self._shift(self.lane)
        digits = self.digits.reshape(-1, self.lanes)
        for row in range(len(digits) - 1, 0, -1):  # carries, from the last digits on
            digits[row - 1] += digits[row] >> 16
        words = digits.astype(np.uint16).astype(">u2").T.copy()
        counts = self.at // self.lanes
        return [words[i, : counts[i]].tobytes() for i in range(self.lanes)]


def _check(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<i4"))


def _lanes(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids as (block, step), and each block's length."""
    count = -(-len(ids) // block)
    lengths = np.full(count, block, dtype=np.int64)
    if count:
        lengths[-1] = len(ids) - block * (count - 1)
    steps = int(lengths.max(initial=0))
    padded = np.full(count * block, ids[-1] if count else 0, dtype=np.int32)
    padded[: len(ids)] = ids
    return padded.reshape(count, block)[:, :steps], lengths


def encode(
    ids: np.ndarray, n_ids: int, block: int = BLOCK, order0: Order0 | None = None
) -> list[bytes]:
    """The blocks of a run of ids, all below ``n_ids`` and in ``order0``."""
    rows, lengths = _lanes(ids, block)
    lanes = len(lengths)
    if not lanes:
        return []
    if int(ids.max()) >= n_ids or int(ids.min()) < 0:
        raise ValueError("an id is out of range")
    order0 = order0 or Order0.even(n_ids)
    places = order0.places(n_ids)
    model, coder = _Model(lanes, n_ids), _Encoder(lanes, _CHOICE + order0.bits)
    spread = np.zeros((2, lanes), dtype=np.int64)
    for a in range(0, rows.shape[1], _BATCH):
        if a % _TURNED == 0:
            turned = np.ascontiguousarray(rows[:, a : a + _TURNED].T)
        now = turned[a % _TURNED :][:_BATCH]
        place = places.take(now)
        if int(place.min()) < 0:
            raise ValueError("an id has no order-0 share")
        spread = np.concatenate([spread[-2:], _spread(now)])
        slots = model.slots(spread[:-2], spread[1:-1])
        coder.room(len(now))
        for start, width in zip(*_shares(model, order0, now, place, slots), strict=True):
            coder.narrow(start, width)
    out = []
    for payload, part, n in zip(coder.finish(), rows, lengths, strict=True):
        check = _check(part[:n])
        out.append(_HEADER.pack(MAGIC, int(n), len(payload) // 2, check) + payload)
    return out


def _shares(model: _Model, order0: Order0, now, place, slots) -> tuple[np.ndarray, np.ndarray]:
    """Starts and widths of the shares of some steps' ids.

    The encoder knows the ids, so only what depends on the step before is done step by step: the
    table, then the shares. The rest is done for all the steps at once.
    """
    own = now.astype(model.table.dtype)
    guess = np.empty(slots.shape, dtype=own.dtype)
    for slot, ids, found in zip(slots, own, guess, strict=True):
        model.table.take(slot, out=found, mode="clip")
        model.table[slot] = ids
    agree = guess[:, 0] == guess[:, 1]
    hits = guess == own[:, None]
    hit2, miss = hits[:, 0], ~(hits[:, 0] | hits[:, 1])
    state = agree * np.int64(model.lanes)
    state += model.lane
    goals, none1 = hits * np.int64(_MOST - _FEW), -hit2.astype(np.int64)
    p2, p1 = np.empty_like(state), np.empty_like(state)
    for i in range(len(own)):
        model.share2.take(state[i], out=p2[i], mode="clip")
        p1[i] = model.share1
        model.adapt(state[i], p2[i], none1[i], goals[i])
    part1 = _part1(p2, p1, agree)
    known = p2 + part1
    # the part of order 2 begins at 0, that of order 1 after it, that of order 0 after both
    head = np.where(miss, known, p2 & ~none1)
    part = np.where(miss, 65536 - known, np.where(hit2, p2, part1))
    return _interval(order0, head, part, np.where(miss, place, order0.whole))


def _interval(order0: Order0, head, part, place) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of what stands at ``place`` in parts of 65536 that begin at ``head``."""
    start = order0.starts.take(place, mode="clip")
    start *= part
    start += head << order0.bits
    part = part * order0.shares.take(place, mode="clip")
    return start.view(np.uint64), part.view(np.uint64)


def decode(blocks: list[bytes], n_ids: int, order0: Order0 | None = None) -> np.ndarray:
    """The ids of blocks, joined; raises ``BlockError`` for damaged ones."""
    if not blocks:
        return np.zeros(0, dtype=np.int64)
    heads = []
    for data in blocks:
        if len(data) < _HEADER.size:
            raise BlockError("a block is too short")
        magic, n, digits, check = _HEADER.unpack_from(data)
        if magic != MAGIC or len(data) != _HEADER.size + 2 * digits:
            raise BlockError("a block has a damaged header")
        heads.append((n, digits, check))
    lanes = len(blocks)
    lengths = np.array([h[0] for h in heads])
    longest = max(h[1] for h in heads)
    words = np.zeros((lanes, longest + 4), dtype=np.uint16)
    for i, data in enumerate(blocks):
        words[i, : heads[i][1]] = np.frombuffer(data, dtype=">u2", offset=_HEADER.size)
    decoder, model = _Decoder(words, order0 or Order0.even(n_ids)), _Model(lanes, n_ids)
    ids = np.zeros((lanes, int(lengths.max())), dtype=np.int32)
    before = last = np.zeros(lanes, dtype=np.int64)
    for first in range(0, ids.shape[1], _TURNED):
        now = np.empty((min(_TURNED, ids.shape[1] - first), lanes), dtype=np.int32)
        for own in now:
            slots = model.slots(before, last)
            decoder.step(model, slots, own)
            model.table[slots] = own.astype(model.table.dtype)
            before, last = last, _spread(own)
        ids[:, first : first + _TURNED] = now.T
    parts = []
    for i, (n, _, check) in enumerate(heads):
        own = ids[i, :n]
        if _check(own) != check:
            raise BlockError(f"block {i} does not match its checksum")
        parts.append(own)
    return np.concatenate(parts)


class _Decoder:
    def __init__(self, words: np.ndarray, order0: Order0):
        lanes, row = words.shape
        self.order0, self.lookup = order0, order0.lookup()
        self.bits = _CHOICE + order0.bits
        self.words = words.ravel()
        self.at = np.arange(lanes, dtype=np.int64) * row
        self.code = np.zeros(lanes, dtype=np.uint64)
        for k in range(4):
            self.code = self.code << _U16 | self.words.take(self.at + k)
        self.at += 4
        self.wide = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
        # of order 2, order 1 and order 0: what ids they have, and where their parts begin and end
        self.ids = np.zeros((3, lanes), dtype=np.int32)
        self.heads = np.zeros((4, lanes), dtype=np.int64)
        self.heads[3] = 65536
        self.third = np.arange(2 * lanes, 3 * lanes)

    def step(self, model: _Model, slots: np.ndarray, ids: np.ndarray) -> None:
        """Find the next id of every block."""
        order0 = self.order0
        self.ids[:2] = model.table.take(slots, mode="clip")
        agree = self.ids[0] == self.ids[1]
        state = agree * np.int64(model.lanes)
        state += model.lane
        p2 = model.share2.take(state, mode="clip")
        self.heads[1] = p2
        np.add(p2, _part1(p2, model.share1, agree), out=self.heads[2])

        unit = self.wide >> np.uint64(self.bits)
        inner = (self.code // unit).view(np.int64)
        np.minimum(inner, (1 << self.bits) - 1, out=inner)  # only a damaged block reaches beyond
        # -1 where the id is in the part of order 2, and where it is in that or the one of order 1
        within = (inner >> order0.bits) - self.heads[1:3]
        within >>= 63
        hit2, seen = within
        model.adapt(state, p2, hit2, within & _MOST - _FEW)
        chosen = hit2 + seen
        chosen *= model.lanes
        chosen += self.third
        head = self.heads.take(chosen, mode="clip")
        part = self.heads.take(chosen + model.lanes, mode="clip")
        part -= head

        inner -= head << order0.bits
        inner = (inner / part).astype(np.int64)  # exact: below 2^53
        place = self.lookup.take(inner, mode="clip").astype(np.int64)
        order0.ids.take(place, out=self.ids[2], mode="clip")
        self.ids.take(chosen, out=ids, mode="clip")
        place ^= (place ^ order0.whole) & seen  # those that were foreseen have all
        self._narrow(unit, *_interval(order0, head, part, place))

    def _narrow(self, unit: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        start *= unit
        self.code -= start
        unit *= width
        # most blocks read a digit
        dry = (unit < _LEAST).astype(np.uint64)
        shift = dry << _U4
        self.code <<= shift
        self.code |= self.words.take(self.at, mode="clip") * dry
        self.at += dry.view(np.int64)
        self.wide = unit << shift
        some = (self.wide < _LEAST).nonzero()[0]
        while len(some):
            some = self._shift(some)

    def _shift(self, some: np.ndarray) -> np.ndarray:
        """Read a digit of some blocks; returns those that need another one."""
        at = self.at.take(some)
        self.code[some] = self.code.take(some) << _U16 | self.words.take(at, mode="clip")
        self.at[some] = at + 1
        short = self.wide.take(some) << _U16
        self.wide[some] = short
        return some[short < _LEAST]
