"""Adaptive context-mixing range coder for token ids, over many independent blocks at once.

Every block starts from the same model, so any block decodes alone with its frame's table; the header holds each block's
number of ids, length and the checksum of its ids. All blocks of a call advance together, one id a step, as lanes of NumPy
arrays. The model uses integers only, so that coder and decoder agree on every machine. For an id,

1. the contexts of order 2 (the last two ids) and order 1 (the last one) each remember an id they expect and how often it
   came; the expected id of order 2, or of order 1 where order 2 has none, is the prediction;
2. the chance that it is right is a mix of two adaptive estimates, one by the confidence of each order, with a weight that
   follows the better one;
3. if it is not right, the id has its chance of order 0, from the frame's table of ids and their frequencies.

The prediction's chance and the table's share of the rest are one interval, so an id is one coding step. The coder is a
carry-less range coder with a 64-bit low end that emits 16 bits at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
HEADER, BLOCK = "<4sQIIIQ", "<III"
MAGIC = b"CMR3"

ONE_BITS = 16
ONE = 1 << ONE_BITS
#: Chances are kept in ONE_BITS and coded in these; what is coded is at least FLOOR from both ends.
CODED_BITS, FLOOR = 12, 2
BITS_1, BITS_2 = 9, 10
CHANCE_RATE = 5
TIMES_BITS = 4
MOST_TIMES = (1 << TIMES_BITS) - 1

_U = np.uint64
_CODED, _LEAST, _MOST = _U(1 << CODED_BITS), _U(FLOOR), _U((1 << CODED_BITS) - FLOOR)
_HASH_1, _HASH_2, _HASH_3, _ODD = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 1))
_SHIFT_1, _SHIFT_2 = np.uint32(32 - BITS_1), np.uint32(32 - BITS_2)
_UP, _DOWN = np.int32(2), np.int32(-2)
#: Up to this many bits, an id's place in the table is looked up; beyond, searched.
LOOKED_UP = 20
#: Ids below this are counted in an array, larger ones sorted.
COUNTED = 1 << 20


class _Table:
    """The ids of a frame, most frequent first, with intervals out of 2**bits in proportion to their frequency."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes.astype(np.uint64)
        self.bits = int(sizes.sum()).bit_length() - 1 if len(ids) else 0
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Table, np.ndarray]:
        """The table of some ids, and each one's place in it."""
        if not len(ids):
            return cls(ids, ids), ids
        if ids.max() < COUNTED:
            often = np.bincount(ids)
            distinct = np.flatnonzero(often)
            often = often[distinct]
            place = np.empty(int(distinct[-1]) + 1, np.int32)
            place[distinct] = np.arange(len(distinct), dtype=np.int32)
            place = place[ids]
        else:
            distinct, place, often = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        total = 1 << max(16, len(distinct).bit_length() + 4)
        # Every id keeps a width of 1; what rounding leaves goes to the most frequent one.
        sizes = 1 + often[order] * (total - len(distinct)) // len(ids)
        sizes[0] += total - sizes.sum()
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        return cls(distinct[order], sizes), back[place]

    def finder(self):
        """A function from places in the interval to places in the table."""
        if self.bits <= LOOKED_UP:
            places = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes.astype(np.int64))
            return lambda value: places.take(value.astype(np.intp))
        ends = np.cumsum(self.sizes)
        return lambda value: np.searchsorted(ends, value, "right").astype(np.int32)

    def pack(self) -> bytes:
        return zlib.compress(self.ids.astype("<u4").tobytes() + self.sizes.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> _Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        return cls(both[:len(both) // 2], both[len(both) // 2:])


class _Model:
    """What `lanes` blocks expect, as places in the table. A slot holds a place and, in its lowest bits, how often it came."""

    def __init__(self, lanes: int, places: int):
        lane = np.arange(lanes)
        self.base = np.stack([lane << BITS_1, (lanes << BITS_1) + (lane << BITS_2)])
        # Place 0 is the frame's most frequent id, which is as good a first guess as any.
        self.kind = np.int32 if places < 1 << (31 - TIMES_BITS) else np.int64
        self.slots = np.zeros((lanes << BITS_1) + (lanes << BITS_2), self.kind)
        self.chance = np.full(2 * lanes * 32, ONE // 8, np.int32)
        self.chance_base = np.stack([lane * 32, (lanes + lane) * 32])
        self.weight = np.full(lanes, 128, np.int32)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def predict(self, n: int):
        """Prediction for the first n lanes and the chance that it is right, out of ONE."""
        last = self.last[:n]
        at = np.empty((2, n), np.intp)
        np.add(self.base[0, :n], (last * _HASH_1) >> _SHIFT_1, out=at[0])
        np.add(self.base[1, :n], ((last + _ODD) * _HASH_2 + self.before[:n] * _HASH_3) >> _SHIFT_2, out=at[1])
        slots = self.slots.take(at)
        places, times = slots >> TIMES_BITS, slots & MOST_TIMES
        cell = self.chance_base[:, :n] + (times << 1)
        cell += places[0] == places[1]
        chance = self.chance.take(cell)
        mixed = chance[1] - chance[0]
        mixed *= self.weight[:n]
        mixed >>= 8
        mixed += chance[0]
        guess = np.where(times[1] > 0, places[1], places[0])
        return guess, mixed, (at, slots, places, times, cell, chance)

    def learn(self, n: int, place: np.ndarray, right: np.ndarray, state):
        at, slots, places, times, cell, chance = state
        away = right * np.int32(ONE - 1) - chance
        self.chance[cell] = chance + (away >> CHANCE_RATE)
        # Right: one more time, up to the most. Wrong: half as often, or the id itself, once.
        other = np.where(times > 1, slots - ((times + 1) >> 1), (place << TIMES_BITS) | 1)
        self.slots[at] = np.where(places == place, slots + (times < MOST_TIMES), other)
        np.abs(away, out=away)
        weight = self.weight[:n]
        weight += np.where(away[1] < away[0], _UP, _DOWN)
        np.minimum(np.maximum(weight, 8, out=weight), 248, out=weight)
        self.before[:n] = self.last[:n]
        self.last[:n] = place


def _intervals(table: _Table, mixed: np.ndarray):
    """Width of the prediction's interval, and that of the rest for each unit of the table."""
    mine = (mixed >> (ONE_BITS - CODED_BITS)).astype(np.uint64)
    np.minimum(np.maximum(mine, _LEAST, out=mine), _MOST, out=mine)
    rest = _CODED - mine
    mine <<= _U(table.bits)
    return mine, rest


def _word_bits(bits: int) -> int:
    """Bits shifted out at a time: the range keeps 64 less than these, and an interval of 2**bits has to fit in."""
    return 32 if bits <= 32 else 16


class _Encoder:
    """Range coder with a 64-bit low end for each lane; a carry is added to the words that are already out."""

    def __init__(self, lanes: int, ids: int, bits: int):
        self.bits, self.shift = _U(bits), _word_bits(bits)
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        self.room = ids * 16 // self.shift + 16
        self.words = np.zeros((lanes, self.room), f"u{self.shift // 8}")
        self.length = np.zeros(lanes, np.int64)

    def put(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """One step of the first n lanes: `size` from `start` out of 2**bits."""
        low, range_ = self.low[:n], self.range[:n]
        range_ >>= self.bits
        start *= range_
        low += start
        range_ *= size
        over = np.flatnonzero(low < start)
        if len(over):
            self._carry(over)
        small = np.flatnonzero(range_ < _U(1 << 64 - self.shift))
        while len(small):
            own, width = low[small], range_[small] << _U(self.shift)
            self._emit(small, own >> _U(64 - self.shift))
            low[small] = own << _U(self.shift)
            range_[small] = width
            small = small[width < _U(1 << 64 - self.shift)]

    def _carry(self, lanes):
        words, at = self.words.reshape(-1), lanes * self.room + self.length[lanes] - 1
        while len(at):
            raised = words[at] + words.dtype.type(1)
            words[at] = raised
            at = at[raised == 0] - 1

    def _emit(self, lanes, words):
        at = self.length[lanes]
        if at.max() >= self.room:
            self.words = np.pad(self.words, ((0, 0), (0, self.room)))
            self.room *= 2
        self.words.reshape(-1)[lanes * self.room + at] = words
        self.length[lanes] = at + 1

    def finish(self):
        for _ in range(64 // self.shift):
            self._emit(np.arange(len(self.low)), self.low >> _U(64 - self.shift))
            self.low <<= _U(self.shift)


class _Decoder:
    """The same without a low end: `code` is what lies above it."""

    def __init__(self, data: bytes, starts: np.ndarray, bits: int):
        self.bits, self.shift = _U(bits), _word_bits(bits)
        self.words = np.append(np.frombuffer(data, f"<u{self.shift // 8}"), np.zeros(1, np.uint32)).astype(np.uint64)
        self.next = starts.copy()
        self.range = np.full(len(starts), 2**64 - 1, np.uint64)
        self.code = np.zeros(len(starts), np.uint64)
        for _ in range(64 // self.shift):
            self.code = (self.code << _U(self.shift)) | self._word(np.arange(len(starts)))

    def _word(self, lanes):
        at = self.next[lanes]
        self.next[lanes] = at + 1
        return self.words.take(at, mode="clip")

    def target(self, n: int) -> np.ndarray:
        self.unit = self.range[:n] >> self.bits
        return np.minimum(self.code[:n] // self.unit, (_U(1) << self.bits) - _U(1))

    def take(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        code, range_ = self.code[:n], self.range[:n]
        start *= self.unit
        code -= start
        np.multiply(self.unit, size, out=range_)
        small = np.flatnonzero(range_ < _U(1 << 64 - self.shift))
        while len(small):
            width = range_[small] << _U(self.shift)
            code[small] = (code[small] << _U(self.shift)) | self._word(small)
            range_[small] = width
            small = small[width < _U(1 << 64 - self.shift)]


def _sizes(n_ids: int, block_ids: int) -> np.ndarray:
    sizes = np.full(-(-n_ids // block_ids), block_ids, np.int64)
    if n_ids % block_ids:
        sizes[-1] = n_ids % block_ids
    return sizes


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Ids (0 to 2**32 - 1) as checksummed blocks."""
    ids = np.asarray(ids).astype("<u4", copy=False)
    sizes = _sizes(len(ids), block_ids)
    table, place = _Table.of(ids)
    model = _Model(len(sizes), len(table.ids))
    coder = _Encoder(len(sizes), int(sizes.max(initial=0)), CODED_BITS + table.bits)
    # Column i holds the i-th id of every block; the last block may be shorter.
    columns = np.zeros(len(sizes) * block_ids, model.kind)
    columns[:len(place)] = place
    columns = np.ascontiguousarray(columns.reshape(-1, block_ids).T)
    for i in range(int(sizes.max(initial=0))):
        n = len(sizes) if i < sizes[-1] else len(sizes) - 1
        own = columns[i, :n]
        guess, mixed, state = model.predict(n)
        right = guess == own
        mine, rest = _intervals(table, mixed)
        start = np.where(right, _U(0), mine + rest * table.starts.take(own))
        coder.put(n, start, np.where(right, mine, rest * table.sizes.take(own)))
        model.learn(n, own, right, state)
    if len(sizes):
        coder.finish()
    packed = table.pack()
    parts = [struct.pack(HEADER, MAGIC, len(ids), block_ids, len(sizes), zlib.crc32(packed), len(packed)), packed]
    for k, size in enumerate(sizes.tolist()):
        part = ids[block_ids * k:block_ids * k + size]
        parts.append(struct.pack(BLOCK, size, int(coder.length[k]), zlib.crc32(part)))
    kind = coder.words.dtype.newbyteorder("<")
    parts += [coder.words[k, :coder.length[k]].astype(kind).tobytes() for k in range(len(sizes))]
    return b"".join(parts)


def decode(code: bytes) -> np.ndarray:
    """The ids of `encode`, as 32-bit integers; raises ValueError when a checksum does not hold."""
    if code[:len(MAGIC)] != MAGIC:
        raise ValueError("not a coded frame")
    _, n_ids, block_ids, n_blocks, table_sum, n_table = struct.unpack_from(HEADER, code)
    at = struct.calcsize(HEADER)
    packed = code[at:at + n_table]
    if zlib.crc32(packed) != table_sum:
        raise ValueError("checksum of the table does not hold")
    table = _Table.unpack(packed)
    at += n_table
    sizes, lengths, sums = np.frombuffer(code, "<u4", 3 * n_blocks, at).reshape(-1, 3).astype(np.int64).T
    model, find = _Model(n_blocks, len(table.ids)), table.finder()
    coder = _Decoder(code[at + struct.calcsize(BLOCK) * n_blocks:], np.cumsum(lengths) - lengths, CODED_BITS + table.bits)
    most = _U((1 << table.bits) - 1)
    columns = np.zeros((block_ids, n_blocks), model.kind)
    for i in range(int(sizes.max(initial=0))):
        n = n_blocks if i < sizes[-1] else n_blocks - 1
        guess, mixed, state = model.predict(n)
        mine, rest = _intervals(table, mixed)
        target = coder.target(n)
        right = target < mine
        other = find(np.minimum((target - np.where(right, target, mine)) // rest, most))
        own = np.where(right, guess, other)
        start = np.where(right, _U(0), mine + rest * table.starts.take(other))
        coder.take(n, start, np.where(right, mine, rest * table.sizes.take(other)))
        columns[i, :n] = own
        model.learn(n, own, right, state)
    ids = table.ids.take(columns).T.reshape(-1)[:n_ids] if n_ids else np.zeros(0, "<u4")
    for k, size in enumerate(sizes.tolist()):
        if zlib.crc32(ids[block_ids * k:block_ids * k + size]) != sums[k]:
            raise ValueError(f"checksum of block {k} does not hold")
    return ids
