"""Token ids in a compressed binary format: an adaptive range coder that mixes three orders.

Pairs of neighbouring ids that are frequent in a frame become symbols of their own, by a list in the frame's first row, so that
fewer symbols are coded than there are ids. The distribution of the next symbol is a weighted sum of three predictions.
Order 2 and order 1 each name the symbol that last followed the last two and the last one, with how often that has held
of late; order 0 is a frequency of every symbol. The weights adapt: every SEGMENT symbols, the weight of each prediction
moves towards how often it was right, apart for each of 32 states of agreement. Doubles that hold integers below 2**53 stand for
the distribution, so that encoder and decoder agree to the bit; symbols keep their natural order in it, and one that several orders
foresee has one interval, as wide as their predictions together. The interval narrows a 48-bit range coder whose
carries are settled at the end.

Symbols are coded in blocks of BLOCK_SYMBOLS. Every block starts anew: empty orders 1 and 2, first
weights, and the order-0 frequencies of its frame; it carries the number of its symbols and ids and two CRC-32, of its
ids and of the whole row. A frame is a few thousand blocks of whole documents; its first row holds the documents' ids and
lengths, the pairs, and the frequencies of symbols in it, in quarter powers of two, so that a block is read with its frame's first.

A reader refuses what is not whole: a changed byte of a row (its checksum), blocks of a frame that are missing,
repeated or out of order (each names its place and how many there are), lengths that do not add up to the
ids, and frames or parts that are missing (the list of parts beside the file has the frames and ids of each).

All blocks of a frame are coded side by side: one numpy step codes the next symbol of every block,
so that no Python code runs per id. Its arrays are made once a frame, those of orders 1 and 2 are the rows of one array, and
no step mixes kinds of numbers, which numpy would convert piece by piece. The file is a table in the shared folder: rows (part, frame,
block, ids before it in the part, sizes, payload), parts in ascending order of ids.

Null texts are empty texts: the end id alone. Null document ids sort first; rows with equal
ids sort by text. An empty table gives an empty file. A document is never cut between frames: a frame
of one very long text is as large as that text. More than 2**19 different ids in one frame are refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_table
from .shared import column, shuffle_partitions, small_batches, table_path
from .words import sliced

#: A block holds so many ids at most: half as many symbols, each an id or two.
BLOCK_IDS, SLOTS = 1024, 1024
BLOCK_SYMBOLS = BLOCK_IDS // 2
#: Ids that one call codes at a time, in blocks side by side.
FRAME_IDS = 3_000_000
#: Order-0 frequencies add up to at most 2**ORDER0, the whole distribution to 2**8 times that.
ORDER0 = 20
#: Weights move every SEGMENT symbols; of what a state has seen, KEEP stays, FIRMNESS uses of the first weights are added at the
#: start and a few later on.
SEGMENT, KEEP, FIRMNESS = 64, 0.85, 8.0
#: A pair becomes a symbol where it occurs so often in a frame; pairs are counted by PAIR_BITS of a hash.
PAIR_LEAST, PAIR_BITS = 24, 20
FIELDS = "part int, frame int, block int, n_blocks int, first long, n_ids int, n_docs int, crc long, n_symbols int, doc_ids binary, no_id binary, lengths binary, pairs binary, prior binary, payload binary, row_crc long"
_COUNT = np.asarray([int(2 ** (k / 4)) for k in range(248)], np.int64)
_LEAST = float(1 << 32)


_NAMES, _KINDS = zip(*map(str.split, FIELDS.split(", ")))
_NUMBERS = [n for n, k in zip(_NAMES[:-1], _KINDS) if k != "binary"]
_BYTES = [n for n, k in zip(_NAMES, _KINDS) if k == "binary"]


def row_crc(row: dict) -> int:
    """CRC-32 of all fields of a row but itself: numbers and lengths of fields of bytes as they print, then the bytes."""
    raw = [row[n] for n in _BYTES]
    head = ";".join([*(str(row[n]) for n in _NUMBERS), *("-" if x is None else str(len(x)) for x in raw)])
    return zlib.crc32(b";".join([head.encode(), *(x for x in raw if x)]))


class Prior:
    """Order-0 frequencies, by rank among the symbols that occur: of each, of all up to it and below it, and the rank at each place."""

    def __init__(self, counts: np.ndarray) -> None:
        self.some = np.flatnonzero(counts)
        k = len(self.some)
        if k > 1 << (ORDER0 - 1):
            raise ValueError(f"{k} different ids in a frame; at most {1 << (ORDER0 - 1)} can be coded")
        self.bits = min(ORDER0, max(16, k.bit_length() + 3))
        c = counts[self.some].astype(np.int64)
        f = 1 + c * ((1 << self.bits) - k) // max(1, int(c.sum()))
        if k:
            f[np.argmax(f)] += (1 << self.bits) - f.sum()
        # the last one, also index -1, is what an empty slot foresees
        self.freq, self.upto = np.append(f, 0).astype(np.float64), np.append(np.cumsum(f), 0).astype(np.float64)
        self.below = self.upto - self.freq
        self.at = np.repeat(np.arange(k, dtype=np.int32), f) if k else np.zeros(1, np.int32)
        self.rank = np.zeros(len(counts) + 1, np.int64)
        self.rank[self.some] = np.arange(k)

    @classmethod
    def uniform(cls, size: int = 65536) -> Prior:
        return cls(np.ones(size, np.int64))

    @staticmethod
    def packed(ids: np.ndarray) -> bytes:
        """The symbols that occur and their counts, rounded down to quarter powers of two."""
        counts = np.bincount(ids)
        some = np.flatnonzero(counts)
        level = np.searchsorted(_COUNT, counts[some], side="right") - 1
        gaps = np.diff(some, prepend=-1).astype("<u4").view(np.uint8).reshape(-1, 4).T
        return zlib.compress(gaps.tobytes() + level.astype(np.uint8).tobytes(), 9)

    @classmethod
    def unpacked(cls, data: bytes | None) -> Prior:
        if data is None:
            return cls.uniform()
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        n = len(raw) // 5
        some = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64)) - 1
        counts = np.zeros(int(some[-1]) + 1 if n else 1, np.int64)
        counts[some] = _COUNT[raw[4 * n :]]
        return cls(counts)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint32)
    h *= np.uint32(40503)
    h += b.astype(np.uint32)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - PAIR_BITS)
    return h


def _hashed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first ids, second ids, hashes) of all pairs of neighbours."""
    return ids[:-1], ids[1:], _pair_hash(ids[:-1], ids[1:]).astype(np.int64)


class Pairs:
    """Frequent pairs of neighbouring ids: pair k stands for the symbol first + k."""

    def __init__(self, first: int, pairs: np.ndarray) -> None:
        self.first, self.pairs = first, pairs

    @classmethod
    def joined(cls, ids: np.ndarray) -> tuple[Pairs, np.ndarray]:
        """(the pairs that occur PAIR_LEAST times, the symbols of ids)."""
        first = int(ids.max(initial=-1)) + 1
        none = cls(first, np.zeros((0, 2), np.int32)), ids
        least = max(PAIR_LEAST, len(ids) >> ORDER0 - 3)  # a frame of one huge text has no more pairs than others
        if len(ids) < 2 * least or first > 1 << ORDER0 - 2 and np.count_nonzero(np.bincount(ids)) > 1 << ORDER0 - 2:
            return none
        # each value of the hash stands for one of its pairs, as long as it is frequent; half a million ids at a time
        cuts = range(0, len(ids) - 1, 1 << 19)
        left, right, counts = (np.zeros(1 << PAIR_BITS, kind) for kind in (np.int32, np.int32, np.int64))
        for k in cuts:
            a, b, h = _hashed(ids[k : k + (1 << 19) + 1])
            left[h], right[h] = a, b
            counts += np.bincount(h, minlength=1 << PAIR_BITS)
        left[counts < least] = -1
        found = np.zeros(len(ids), bool)
        for k in cuts:
            a, b, h = _hashed(ids[k : k + (1 << 19) + 1])
            found[k : k + len(h)] = (left.take(h) == a) & (right.take(h) == b)
        at = np.flatnonzero(found)
        if not len(at):
            return none
        # of pairs that overlap in a run, every other one
        place = np.arange(len(at), dtype=np.int32)
        begin = np.ones(len(at), bool)
        np.greater(at[1:] - at[:-1], 1, out=begin[1:])
        at = at[(place - np.maximum.accumulate(np.where(begin, place, np.int32(0))) & 1) == 0]
        h = _pair_hash(ids[at], ids[at + 1])
        used = np.zeros(1 << PAIR_BITS, bool)
        used[h] = True
        some = np.flatnonzero(used)
        number = np.zeros(1 << PAIR_BITS, np.int32)
        number[some] = first + np.arange(len(some), dtype=np.int32)
        out = ids.astype(np.int32)
        out[at] = number.take(h)
        live = np.ones(len(ids), bool)
        live[at + 1] = False
        return cls(first, np.stack((left[some], right[some]), axis=1)), out[live]

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return 1 + (symbols >= self.first)

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols."""
        if not len(self.pairs):
            return symbols
        pair = np.flatnonzero(symbols >= self.first)
        out = np.repeat(symbols, self.sizes(symbols))
        found = self.pairs.take(symbols[pair] - self.first, axis=0, mode="clip")
        at = pair + np.arange(len(pair))
        out[at], out[at + 1] = found[:, 0], found[:, 1]
        return out

    def packed(self) -> bytes:
        return zlib.compress(np.int64(self.first).tobytes() + np.ascontiguousarray(self.pairs.astype("<u4").view(np.uint8).reshape(-1, 8).T).tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Pairs:
        raw = zlib.decompress(data)
        return cls(int(np.frombuffer(raw[:8], "<i8")[0]), np.ascontiguousarray(np.frombuffer(raw[8:], np.uint8).reshape(8, -1).T).view("<u4").astype(np.int32))


# first weights of orders 1 and 2 in percent, by how often each has held (0: no prediction yet, 3: thrice or more);
# a pair for predictions that differ and one for predictions that agree: about what the weights come to at the ends of blocks
_FIRST = {
    (0, 0): ((0, 0), (0, 0)), (0, 1): ((0, 30), (0, 54)), (0, 2): ((0, 75), (0, 78)), (0, 3): ((0, 85), (0, 90)),
    (1, 0): ((5, 0), (15, 0)), (1, 1): ((3, 4), (5, 12)), (1, 2): ((12, 43), (2, 38)), (1, 3): ((19, 60), (19, 70)),
    (2, 0): ((28, 0), (40, 0)), (2, 1): ((24, 2), (18, 22)), (2, 2): ((14, 50), (12, 41)), (2, 3): ((6, 80), (18, 67)),
    (3, 0): ((61, 0), (60, 0)), (3, 1): ((54, 3), (32, 40)), (3, 2): ((22, 63), (19, 65)), (3, 3): ((9, 80), (18, 67)),
}
# of predictions that agree, the weight is all order 1's
_START = np.asarray([((w1, w2), (w1 + w2, 0))[same] for n1 in range(4) for n2 in range(4) for same, (w1, w2) in enumerate(_FIRST[n1, n2])]) / 100


def _constant(value: int, kind: type) -> np.ndarray:
    """An array of one: numpy converts Python's numbers at every call."""
    return np.asarray([value], kind)


_FIVE, _STATE, _THREE, _NEAR, _FAR = _constant(5, np.int32), _constant(31, np.int32), _constant(3, np.int64), _constant(40503, np.int64), _constant(48271, np.int64)
_ZERO, _ONE, _FEW = _constant(0, float), _constant(1, float), _constant(_LEAST, float)


class _Mixer:
    """The three orders and their weights, for many blocks side by side.

    A slot of orders 1 and 2 holds a rank and, below it in five bits, how often it has held: times eight in order 1, times two in order 2.
    """

    def __init__(self, lanes: int, bits: int) -> None:
        self.lanes, self.bits = lanes, bits
        self.table = np.full(2 * lanes * SLOTS, -32, np.int32)
        # uses of each state, and how often orders 1 and 2 were right in it
        self.counts = np.stack([np.full(lanes * 32, FIRMNESS), *(np.tile(w * FIRMNESS, lanes) for w in _START.T)])
        self.again = self.counts * (2 * (1 - KEEP) / FIRMNESS)
        self.nows, self.hits, self.seen = np.zeros((SEGMENT, lanes), np.int64), np.zeros((2, SEGMENT, lanes), bool), 0
        self.slot, self.state = np.arange(2 * lanes).reshape(2, lanes) * SLOTS, np.arange(lanes) * 32
        self.key, self.far = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64)
        self._weigh()
        self.shrink(lanes)

    def shrink(self, n: int) -> None:
        """Only the first n blocks go on."""
        self.n = n
        self.slot, self.state, self.key, self.far = self.slot[:, :n].copy(), self.state[:n], self.key[:, :n].copy(), self.far[:n].copy()
        self.h, self.c, self.mask = np.empty((2, n), np.int64), np.empty((2, n), np.int64), np.full((2, n), SLOTS - 1)
        self.v, self.c4, self.held = (np.empty((2, n), np.int32) for _ in range(3))
        self.low, self.top, self.step = (np.repeat(np.asarray(x, np.int32)[:, None], n, axis=1) for x in ((24, 6), (16, 4), (8, 2)))
        self.j, self.agree, self.same = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, bool)
        self.m, self.f, self.m0 = np.empty((2, n)), np.empty((2, n)), np.empty(n)
        self.hit, self.less = np.empty((2, n), bool), np.empty((2, n), bool)

    def _weigh(self) -> None:
        """t0, t1, t2: by state, m0 for each order-0 frequency, m1 and m2: what orders 1 and 2 add; all of it comes to 2**(bits + 8)."""
        used, one, two = self.counts
        foreseen = one + two
        self.t0 = 256 - np.floor(foreseen * 255 / used)
        rest = (256 - self.t0) * (1 << self.bits)
        self.t1 = np.floor(rest * one / np.maximum(foreseen, 1e-9))
        self.t2 = rest - self.t1

    def _adapt(self) -> None:
        k, n = self.seen, self.n
        key = np.left_shift(self.nows[:k, :n], 2)
        hits = self.hits[:, :k, :n].view(np.int8)
        key += hits[0] << 1 | hits[1]
        got = np.bincount(key.ravel(), minlength=self.lanes * 128).reshape(-1, 4)
        one, two = got[:, 2] + got[:, 3], got[:, 1]  # where both are right they agree, and the weight is order 1's
        np.multiply(self.counts, KEEP, out=self.counts)
        np.add(self.counts, self.again, out=self.counts)
        for row, new in zip(self.counts, (got[:, 0] + one + two, one, two)):
            np.add(row, new, out=row)
        self.seen = 0
        self._weigh()

    def predict(self) -> None:
        """c: what orders 1 and 2 foresee; m0 and m: the weights."""
        if self.seen == SEGMENT:
            self._adapt()
        h, v, c4, j = self.h, self.v, self.c4, self.j
        np.bitwise_and(self.key, self.mask, out=h)
        np.add(h, self.slot, out=h)
        self.table.take(h, out=v, mode="wrap")
        np.right_shift(v, _FIVE, out=c4)
        np.copyto(self.c, c4)
        np.add(v[0], v[1], out=j)
        np.bitwise_and(j, _STATE, out=j)
        np.equal(c4[0], c4[1], out=self.same)
        np.copyto(self.agree, self.same)
        np.add(j, self.agree, out=j)
        now = self.nows[self.seen, : self.n]
        np.copyto(now, j)
        np.add(now, self.state, out=now)
        self.t0.take(now, out=self.m0, mode="wrap")
        self.t1.take(now, out=self.m[0], mode="wrap")
        self.t2.take(now, out=self.m[1], mode="wrap")

    def interval(self, ranks: np.ndarray, prior: Prior, start: np.ndarray, width: np.ndarray) -> None:
        """Where the interval of each rank starts and how wide it is."""
        f, m, m0 = self.f, self.m, self.m0
        np.equal(self.c, ranks, out=self.hit)
        np.less(self.c, ranks, out=self.less)
        for out, order0, which in ((start, prior.below, self.less), (width, prior.freq, self.hit)):
            np.copyto(f, which)
            np.multiply(f, m, out=f)
            order0.take(ranks, out=out, mode="wrap")
            np.multiply(out, m0, out=out)
            np.add(out, f[0], out=out)
            np.add(out, f[1], out=out)

    def learn(self, ranks: np.ndarray) -> None:
        """After interval of the same ranks."""
        v, held, j, key = self.v, self.held, self.j, self.key
        self.hits[:, self.seen, : self.n] = self.hit
        self.seen += 1
        # a prediction that was right has held once more, thrice at most; any other gives way
        np.bitwise_and(v, self.low, out=v)
        np.minimum(v, self.top, out=v)
        np.copyto(held, self.hit)
        np.multiply(v, held, out=v)
        np.add(v, self.step, out=v)
        np.copyto(j, ranks, casting="unsafe")
        np.left_shift(j, _FIVE, out=j)
        np.add(v, j, out=v)
        self.table[self.h] = v
        np.multiply(ranks, _NEAR, out=key[0])
        np.add(key[0], self.far, out=key[1])
        np.right_shift(key[1], _THREE, out=key[1])
        np.multiply(key[0], _FAR, out=self.far)


def _grid(blocks: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(blocks from the longest on, their sizes, their ids step by step)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.asarray([len(blocks[i]) for i in order], np.int64)
    grid = np.zeros((len(order), int(sizes.max(initial=0))), np.int32)
    for row, i in enumerate(order):
        grid[row, : len(blocks[i])] = blocks[i]
    return order, sizes, np.ascontiguousarray(grid.T)


def _live(sizes: np.ndarray, steps: int) -> list[int]:
    """At each step the number of blocks that go on; sizes from the longest on."""
    return np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()


def encode_blocks(blocks: list[np.ndarray], prior: Prior | None = None) -> list[bytes]:
    """The payload of each block of ids that the prior knows (without one: of ids below 65536)."""
    prior = prior or Prior.uniform()
    order, sizes, grid = _grid(blocks)
    grid = prior.rank.take(grid)
    lanes = len(order)
    mixer = _Mixer(lanes, prior.bits)
    scale = _constant(2.0 ** -(prior.bits + 8), float)
    low, rng = np.zeros(lanes), np.full(lanes, float(1 << 48))
    name = np.arange(lanes, dtype=np.uint16 if lanes <= 1 << 16 else np.int64)
    who, what = [], []

    def shift(at: np.ndarray) -> None:
        l = low[at]
        word = np.floor(l * 2.0**-32)  # the seventeenth bit is a carry
        who.append(name[at])
        what.append(word.astype(np.int32))
        low[at] = (l - word * 2.0**32) * 65536

    every = np.arange(lanes)
    for k, n in enumerate(_live(sizes, len(grid))):
        if n < mixer.n:
            mixer.shrink(n)
        if k == 0 or n < len(unit):
            unit, start, width, few, ranges, lows = np.empty(n), np.empty(n), np.empty(n), np.empty(n, bool), rng[:n], low[:n]
        ranks = grid[k, :n]
        mixer.predict()
        mixer.interval(ranks, prior, start, width)
        np.multiply(ranges, scale, out=unit)
        np.floor(unit, out=unit)
        np.multiply(start, unit, out=start)
        np.add(lows, start, out=lows)
        np.multiply(width, unit, out=ranges)
        np.less(ranges, _FEW, out=few)
        at = few.nonzero()[0]
        while len(at):
            shift(at)
            r = rng[at] * 65536
            rng[at] = r
            at = at[r < _LEAST]
        mixer.learn(ranks)
    for _ in range(3):
        shift(every)
    who = np.concatenate(who)
    words = np.concatenate(what)[np.argsort(who, kind="stable")]
    ends = np.cumsum(np.bincount(who, minlength=lanes)).tolist()
    while len(over := np.flatnonzero(words >> 16)):
        words[over] &= 0xFFFF
        words[over - 1] += 1
    small = words.astype("<u2").tobytes()
    out = [b""] * lanes
    for i, a, b in zip(order, [0, *ends], ends):
        out[i] = small[2 * a : 2 * b]
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int], prior: Prior | None = None) -> list[np.ndarray]:
    """The ids of each block again."""
    prior = prior or Prior.uniform()
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    n_ids = np.asarray([sizes[i] for i in order], np.int64)
    lanes = len(order)
    grid = np.zeros((int(n_ids.max(initial=0)), lanes), np.int32)
    mixer = _Mixer(lanes, prior.bits)
    scale = _constant(2.0 ** -(prior.bits + 8), float)
    room = np.asarray([len(payloads[i]) // 2 + 4 for i in order], np.int64)
    next_word = np.cumsum(room) - room
    words = np.frombuffer(b"".join(payloads[i][: len(payloads[i]) // 2 * 2] + bytes(8) for i in order), "<u2")
    code, rng = np.zeros(lanes), np.full(lanes, float(1 << 48))

    def shift(at: np.ndarray) -> None:
        word = next_word[at]
        code[at] = code[at] * 65536 + words.take(word, mode="clip")
        next_word[at] = word + 1

    for _ in range(3):
        shift(np.arange(lanes))
    for k, n in enumerate(_live(n_ids, len(grid))):
        if n < mixer.n:
            mixer.shrink(n)
        if k == 0 or n < len(unit):
            unit, target, width, ends, few, place, ranks = np.empty(n), np.empty(n), np.empty(n), np.empty((2, n)), np.empty(n, bool), np.empty(n, np.int64), np.empty(n, np.int64)
            codes, ranges = code[:n], rng[:n]
        mixer.predict()
        m0, m, c, f = mixer.m0, mixer.m, mixer.c, mixer.f
        np.multiply(ranges, scale, out=unit)
        np.floor(unit, out=unit)
        np.divide(codes, unit, out=target)  # of integers below 2**49 with a quotient below 2**30: exact
        np.floor(target, out=target)
        # what a foreseen symbol has beyond its order-0 share lies at the end of that share; without it, order 0 has the place
        prior.upto.take(c, out=ends, mode="wrap")
        np.multiply(ends, m0, out=ends)
        np.less(c, c[::-1], out=mixer.less)
        np.copyto(f, mixer.less)
        np.multiply(f, m, out=f)
        np.add(ends, f[::-1], out=ends)
        np.add(target, _ONE, out=width)
        np.subtract(width, ends, out=ends)
        np.maximum(ends, _ZERO, out=ends)
        np.minimum(ends, m, out=ends)
        np.subtract(target, ends[0], out=target)
        np.subtract(target, ends[1], out=target)
        np.divide(target, m0, out=target)
        np.copyto(place, target, casting="unsafe")
        row = grid[k, :n]
        prior.at.take(place, out=row, mode="clip")
        np.copyto(ranks, row)
        mixer.interval(ranks, prior, target, width)
        np.multiply(target, unit, out=target)
        np.subtract(codes, target, out=codes)
        np.multiply(width, unit, out=ranges)
        np.less(ranges, _FEW, out=few)
        at = few.nonzero()[0]
        while len(at):
            shift(at)
            r = rng[at] * 65536
            rng[at] = r
            at = at[r < _LEAST]
        mixer.learn(ranks)
    out = [np.zeros(0, np.int64)] * lanes
    flat = np.ascontiguousarray(grid.T)
    for lane, i in enumerate(order):
        out[i] = prior.some[flat[lane, : sizes[i]]] if sizes[i] else out[i]
    return out


def _written_blocks(vocabulary: str, end: int):
    """Rows (part, id, text) in order of id; rows of FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(vocabulary)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        part, frame, first, total = -1, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, frame, first, total
            ids = np.concatenate(held)
            pairs, symbols = Pairs.joined(ids)
            packed = Prior.packed(symbols)
            pieces = [symbols[k : k + BLOCK_SYMBOLS] for k in range(0, len(symbols), BLOCK_SYMBOLS)]
            ends = np.cumsum([int(pairs.sizes(x).sum()) for x in pieces]).tolist()
            made = encode_blocks(pieces, Prior.unpacked(packed))
            head = (np.asarray([x or 0 for x in names], "<i8").tobytes(), np.flatnonzero([x is None for x in names]).astype("<u4").tobytes(), np.asarray(list(map(len, held)), "<i8").tobytes(), pairs.packed(), packed)
            rows = []
            for k, (x, payload, a, b) in enumerate(zip(pieces, made, [0, *ends], ends)):
                crc = zlib.crc32(ids[a:b].astype("<u4").tobytes())
                row = dict(zip(_NAMES, (part, frame, k, len(pieces), first + a, b - a, 0 if k else len(names), crc, len(x), *((None,) * 5 if k else head), payload), strict=False))
                rows.append([*row.values(), row_crc(row)])
            held, names, frame, first, total = [], [], frame + 1, first + len(ids), 0
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            return pa.record_batch([pa.array(column, kinds[kind]) for column, kind in zip(zip(*rows), _KINDS)], list(_NAMES))

        for rows in sliced(batches, 2):
            for p, name, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), table.encode(rows.column(2).fill_null("").to_pylist())):
                if held and (p != part or total >= FRAME_IDS):
                    yield flush()
                if p != part:
                    part, frame, first = p, 0, 0
                held.append(np.append(ids, np.int32(end)))
                names.append(name)
                total += len(held[-1])
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, vocabulary: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends the end id, and writes all ids in ascending order of id_col.

    Parts are ranges of (id, the text's beginning), so that a repeated id is no single part.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    parts = shuffle_partitions(docs.sparkSession)
    placed = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.substring(F.coalesce("text", F.lit("")), 1, 8))
    placed = placed.sortWithinPartitions(F.col("id").asc_nulls_first(), F.coalesce("text", F.lit(""))).select(F.spark_partition_id().alias("part"), "id", "text")
    with small_batches(docs.sparkSession):
        placed.mapInArrow(_written_blocks(vocabulary, end), FIELDS).write.parquet(path)
    spark = docs.sparkSession
    _sizes(spark.read.schema(FIELDS).parquet(path)).write.parquet(f"{path}.parts")


def _sizes(blocks: DataFrame) -> DataFrame:
    """(part, frames, blocks, n): one row for each task that wrote."""
    return blocks.groupBy("part").agg(F.count_if(F.col("block") == 0).alias("frames"), F.count("*").alias("blocks"), F.sum("n_ids").alias("n"))


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each frame, which come in order; its first row names the documents."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["part"], row["frame"]) != (held[0]["part"], held[0]["frame"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _whole(rows: list[dict]) -> None:
    """Raises where the rows of a frame are not all of its blocks, each once, in order, and as they were written."""
    head = rows[0]
    where = f"frame {head['frame']} of part {head['part']}"
    for r in rows:
        if row_crc(r) != r["row_crc"]:
            raise ValueError(f"block {r['block']} of {where} is damaged")
    if [r["block"] for r in rows] != list(range(head["n_blocks"])) or any(r["n_blocks"] != head["n_blocks"] for r in rows):
        raise ValueError(f"{where} lacks blocks or holds some twice")
    ids = [r["n_ids"] for r in rows]
    if [r["first"] for r in rows] != (head["first"] + np.cumsum([0, *ids[:-1]])).tolist():
        raise ValueError(f"blocks of {where} do not follow each other")
    n = np.frombuffer(head["lengths"], "<i8")
    if n.sum() != sum(ids) or len(n) != head["n_docs"] or len(head["doc_ids"]) != 8 * len(n):
        raise ValueError(f"documents of {where} are not as long as its blocks")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS in order of part, frame and block; per document its ids' place in the part, number and CRC-32."""
    for rows in _frames(batches):
        _whole(rows)
        head = rows[0]
        pairs = Pairs.unpacked(head["pairs"])
        found = decode_blocks([r["payload"] for r in rows], [r["n_symbols"] for r in rows], Prior.unpacked(head["prior"]))
        data = memoryview(pairs.ids(np.concatenate(found)).astype("<u4").tobytes())
        ends = np.cumsum([4 * r["n_ids"] for r in rows]).tolist()
        for r, x, a, b in zip(rows, found, [0, *ends], ends):
            if pairs.sizes(x).sum() != r["n_ids"] or zlib.crc32(data[a:b]) != r["crc"]:
                raise ValueError(f"block {r['block']} of frame {r['frame']} of part {r['part']} is damaged")
        names = np.frombuffer(head["doc_ids"], "<i8").tolist()
        for k in np.frombuffer(head["no_id"] or b"", "<u4").tolist():
            names[k] = None
        n = np.frombuffer(head["lengths"], "<i8")
        at = np.concatenate(([0], np.cumsum(n)))
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        first = head["first"]
        yield pa.record_batch([pa.array([head["part"]] * len(n), pa.int32()), pa.array(names, pa.int64()), pa.array(first + at[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a file: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(FIELDS).parquet(path)
    deal = shuffle_partitions(spark)
    got = blocks.repartition(deal, "part", "frame").sortWithinPartitions("part", "frame", "block").mapInArrow(_read_blocks, "part int, id long, start long, n_tokens long, ids_crc32 long")
    # one row for each task that wrote
    sizes = sorted(map(tuple, spark.read.schema("part int, frames long, blocks long, n long").parquet(f"{path}.parts").collect()))
    found = sorted(map(tuple, _sizes(blocks).collect()))
    if found != sizes:
        raise ValueError(f"parts {sorted({p[0] for p in set(sizes) ^ set(found)})} are not whole")
    before = np.cumsum([0, *[n for *_, n in sizes]]).tolist()
    offsets = spark.createDataFrame([(p[0], b) for p, b in zip(sizes, before)], "part int, before long")
    got = got.join(F.broadcast(offsets), "part")
    return got.select(F.col("id").alias(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to a new file in the shared folder and reads its documents."""
    path = table_path(docs.sparkSession, "ids")
    write_ids(docs, vocabulary, path, end, id_col, text_col)
    return read_documents(docs.sparkSession, path, id_col)
