"""Ids of texts for the coder: chunks are cut by whole-array comparisons and looked up in a hash table.

The splitting rule is that of `token_counts`. It is local but for runs of one kind: a chunk begins where
the kind of character changes, a white run gives its last character to what follows, and an apostrophe that begins a
chunk may take the one or two letters of a contraction. So no state has to be carried along a text.
Ids of a chunk come from the library's model, asked once for each chunk that a Python worker meets; the table, of
at most TABLE chunks, outlives a task and serves the next one of the worker.
"""

from __future__ import annotations

import functools

import numpy as np

from .token_counts import APOSTROPHE, END, NUMBER, ONE, RV, SPACE, WHITE, ChunkIds, E, L, _classes
from .words import _VALUE_BYTES, mix, powers

TABLE = 1_000_000
#: letters 0, numbers 1, white 2, other marks 3, ends 4
_KIND = np.full(END + 1, 3, np.uint8)
_KIND[: L + 1], _KIND[NUMBER], _KIND[[SPACE, WHITE]], _KIND[END] = 0, 1, 2, 4


def _byte_level() -> np.ndarray:
    """The character that byte-level vocabularies write for each byte."""
    out = np.zeros(256, "<u4")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out[plain] = plain
    out[out == 0] = 256 + np.arange(256 - len(plain))
    return out


_CHARACTER = _byte_level()


def starts(cls: np.ndarray) -> np.ndarray:
    """For each character whether a chunk begins there. The classes end with END after every text."""
    kind = _KIND.take(cls)
    begins = np.ones(len(cls), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    # what follows a space begins with it, and the last of a white run is cut off for what follows
    white, solid = kind == 2, (kind != 2) & (kind != 4)
    begins[1:] &= ~(solid[1:] & (cls[:-1] == SPACE))
    begins[:-1] |= white[:-1] & solid[1:]
    begins &= kind != 4
    quote = np.flatnonzero(cls == APOSTROPHE)
    quote = quote[begins[quote]]
    one, two = cls[quote + 1], cls[np.minimum(quote + 2, len(cls) - 1)]
    short, long = one == ONE, (one == RV) & (two == E) | (one == L) & (two == L)
    begins[quote[short | long] + 1] = False
    after = np.concatenate((quote[short] + 2, quote[long] + 3))
    begins[after[kind[after] == 0]] = True
    return begins


class ChunkTable(ChunkIds):
    """Ids of texts like ChunkIds, with a hash table of open addresses."""

    def clear(self) -> None:
        super().clear()
        self.keys, self.which, self.held = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The chunk of each hash, -1 for unknown ones."""
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).view(np.int64)
        key = self.keys.take(at)
        out = np.where(key == hashes, self.which.take(at), np.int32(-1))
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            at[left] = at[left] + 1 & mask
            key, want = self.keys[at[left]], hashes[left]
            found = key == want
            out[left[found]] = self.which[at[left[found]]]
            left = left[~found & (key != 0)]
        return out

    def _insert(self, hashes: np.ndarray, which: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).view(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = hashes[free]
            self.which[at[free]] = which[free]
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = at[left] + 1 & mask

    def of(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """The chunk of each hash; text_of gives, for places in hashes, the chunks as the vocabulary writes them."""
        chunk = self._find(hashes)
        unknown = np.flatnonzero(chunk < 0)
        if not len(unknown):
            return chunk
        if self.held > TABLE:
            self.clear()
            unknown = np.arange(len(hashes))
        new, place, where = np.unique(hashes[unknown], return_index=True, return_inverse=True)
        ask, ids, ends = self.tok.model.tokenize, [], []
        for text in text_of(unknown[place]):
            ids += [token.id for token in ask(text)]
            ends.append(len(ids))
        which = (len(self.ends) - 1 + np.arange(len(new))).astype(np.int32)
        self.pool = np.concatenate((self.pool, np.asarray(ids, np.int32)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.asarray(ends, np.int64)))
        self.held += len(new)
        if 2 * self.held > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, held = self.keys[old], self.which[old]
            size = 1 << int(2 * self.held).bit_length()
            self.keys, self.which = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(keys, held)
        self._insert(new, which)
        chunk[unknown] = which[where]
        return chunk

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = "\0".join(texts) + "\0"
        codes = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        cls = _classes().take(codes)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cls[ends] = END
        begins = starts(cls)
        first_of = np.concatenate(([0], np.cumsum(np.add.reduceat(begins, np.concatenate(([0], ends[:-1] + 1)), dtype=np.int64))))
        begins[ends] = True
        stops = np.flatnonzero(begins)
        begun = np.flatnonzero(cls[stops] != END)
        if not len(begun):
            return begun, first_of
        raw = data.encode()
        buf = np.frombuffer(raw, np.uint8)
        if len(buf) != len(codes):
            # places in bytes: of the bytes that do not continue a character
            stops = np.flatnonzero(buf & 0xC0 != 0x80)[stops]
        a, b = stops[begun], stops[begun + 1]
        up, down = powers(len(buf))
        acc = np.zeros(len(buf) + 1, np.uint64)
        np.multiply(_VALUE_BYTES.take(buf), up, out=acc[1:])
        np.cumsum(acc[1:], out=acc[1:])
        h = mix((acc[b] - acc[a]) * down[a] + (b - a).astype(np.uint64))
        h[h == 0] = 1

        def text_of(places: np.ndarray) -> list[str]:
            n = b[places] - a[places] + 1
            to = np.cumsum(n)
            letters = _CHARACTER[buf[np.minimum(np.arange(to[-1]) + np.repeat(a[places] - to + n, n), len(buf) - 1)]]
            letters[to - 1] = 0
            return letters.tobytes().decode("utf-32-le").split("\0")[:-1]

        return self.of(h, text_of), first_of


@functools.lru_cache(maxsize=1)
def chunk_table(path: str) -> ChunkTable:
    """The table of this Python worker."""
    return ChunkTable(path)
