"""Token counts by a compiled finite-state tokenizer.

The splitting rule of byte-level BPE vocabularies (contractions, letters, numbers, other
marks, white space, each with at most one space before it) is compiled to a deterministic
transducer over eleven classes of characters: a transition says whether a chunk begins at
the character and whether one begins at the character before it. A few MB of text are cut
into lanes of LANE characters; every lane maps each state in which it may be entered to the
state in which it is left, the maps of the lanes compose by a parallel prefix scan, and a second
pass from the true states writes the chunk boundaries. The second transducer reads chunks: its
transitions are annotated with the number of tokens that the vocabulary's merges emit for
the chunk, compiled when a task meets the chunk for the first time. A table of at most TABLE
chunks is kept per task.

Null texts are empty texts with no tokens. Texts that hold special strings of the vocabulary
are left to the library, whose rules for these strings differ by vocabulary. Chunks are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import _VALUE_BYTES, mix, powers, slices

LANE, TABLE = 64, 1_500_000
# classes of characters
LETTER, ONE, RV, E, L, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, END = range(11)
# states
START, LETTERS, NUMBERS, OTHERS, SPACE1, WHITE1, SPACES, WHITES, QUOTE, QUOTE_RV, QUOTE_L, DONE = range(12)
# what begins: a chunk at the character, at the one before it, or both
HERE, BEFORE = 1, 2


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what begins), both indexed by class * states + state."""
    step, out = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    letters = (LETTER, ONE, RV, E, L)

    def fresh(c: int) -> int:
        """The state after a chunk begins with this class."""
        return LETTERS if c in letters else {NUMBER: NUMBERS, SPACE: SPACE1, WHITE: WHITE1, APOSTROPHE: QUOTE, OTHER: OTHERS, END: START}[c]

    for c in range(11):
        after_space = OTHERS if c == APOSTROPHE else fresh(c)
        same = {LETTERS: letters, NUMBERS: (NUMBER,), OTHERS: (OTHER, APOSTROPHE)}
        for s in range(12):
            state, begins = fresh(c), HERE
            if s in same and c in same[s]:
                state, begins = s, 0
            elif s == SPACE1 and c not in (SPACE, WHITE, END):
                state, begins = after_space, 0
            elif s in (SPACE1, WHITE1, SPACES, WHITES) and c in (SPACE, WHITE):
                state, begins = (SPACES if c == SPACE else WHITES), 0
            elif s == SPACES and c != END:
                state, begins = after_space, BEFORE
            elif s == WHITES and c != END:
                begins = HERE | BEFORE
            elif s == QUOTE and c == ONE:
                state, begins = DONE, 0
            elif s == QUOTE and c == RV:
                state, begins = QUOTE_RV, 0
            elif s == QUOTE and c == L:
                state, begins = QUOTE_L, 0
            elif s == QUOTE and c in (OTHER, APOSTROPHE):
                state, begins = OTHERS, 0
            elif (s, c) in ((QUOTE_RV, E), (QUOTE_L, L)):
                state, begins = DONE, 0
            elif s in (QUOTE_RV, QUOTE_L):
                # no contraction: letters began at the character before
                state, begins = (LETTERS, BEFORE) if c in letters else (fresh(c), HERE | BEFORE)
            step[c, s], out[c, s] = state, begins
    return step.ravel(), out.ravel()


_STEP, _OUT = _transducer()


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kind = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    out[kind == ord("L")] = LETTER
    out[kind == ord("N")] = NUMBER
    out[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    for letters, c in (("stmd", ONE), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(x) for x in letters]] = c
    return out


def chunk_starts(cls: np.ndarray) -> np.ndarray:
    """For each character whether a chunk begins there. The classes end with END after every text."""
    n = len(cls)
    lanes = -(-n // LANE)
    grid = np.full(lanes * LANE, END, np.uint8)
    grid[:n] = cls
    rows = np.ascontiguousarray(grid.reshape(lanes, LANE).T).astype(np.uint16) * 12
    # 1. the map of every lane
    maps = np.tile(np.arange(12, dtype=np.uint8), (lanes, 1))
    for row in rows:
        maps = _STEP[row[:, None] + maps]
    # 2. prefix scan: maps[i] becomes the composition of lanes 0 to i
    gap = 1
    while gap < lanes:
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), axis=1)
        gap *= 2
    # 3. once more, from the true states
    state = np.concatenate(([START], maps[:-1, START])).astype(np.uint16)
    marks = np.empty((LANE, lanes), np.uint8)
    for k, row in enumerate(rows):
        at = row + state
        marks[k] = _OUT[at]
        state = _STEP[at]
    marks = marks.T.ravel()[:n]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return begins


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary with the usual splitting rule")
    return Tokenizer.from_file(path)


class ChunkIds:
    """Chunks of bytes by hash, and the ids that each emits."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and which chunk each is
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # all ids, and where those of each chunk end

    def of(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """The chunks of distinct hashes, ascending; text_of gives the texts of new ones by place."""
        if len(self.known) > TABLE:
            self.clear()
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            found = [x.ids for x in self.tok.encode_batch_fast(text_of(new), add_special_tokens=False)]
            first = len(self.ends) - 1
            self.pool = np.concatenate((self.pool, np.fromiter(itertools.chain.from_iterable(found), np.int32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(list(map(len, found)))))
            self.known, self.place = np.insert(self.known, at[new], hashes[new]), np.insert(self.place, at[new], np.arange(first, first + len(new)))
            at = np.searchsorted(self.known, hashes)
        return self.place[at]

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the chunk at each place of all texts, for each text the index of its first chunk, and the total)."""
        data = "\0".join(texts) + "\0"
        codes = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        cls = _classes()[codes]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cls[ends] = END
        begins = chunk_starts(cls)
        begins[ends] = False
        raw = data.encode()
        buf = np.frombuffer(raw, np.uint8)
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        first = np.flatnonzero(begins)
        if not len(first):
            return first, np.zeros(len(texts) + 1, np.int64)
        # a chunk ends where the next begins or its text ends
        stops = np.flatnonzero(begins | (cls == END))
        last = stops[np.searchsorted(stops, first) + 1]
        a, b = byte_at[first], byte_at[last]
        up, down = powers(len(buf))
        acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE_BYTES[buf] * up)))
        h = mix((acc[b] - acc[a]) * down[a] + (b - a).astype(np.uint64))
        distinct, place, where = np.unique(h, return_index=True, return_inverse=True)
        chunk = self.of(distinct, lambda new: [raw[a[k] : b[k]].decode() for k in place[new].tolist()])
        return chunk[where], np.concatenate(([0], np.searchsorted(first, ends)))

    def _odd(self, texts: list[str]) -> tuple[list[str], dict[int, list[int]]]:
        """Texts that hold special strings are the library's alone, whatever the rules of these strings: their ids by place."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not odd:
            return texts, {}
        ids = dict(zip(odd, (x.ids for x in self.tok.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False))))
        return ["" if i in ids else t for i, t in enumerate(texts)], ids

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        texts, odd = self._odd(texts)
        chunk, at = self._chunks(texts)
        total = np.concatenate(([0], np.cumsum(np.diff(self.ends)[chunk])))[at]
        out = np.diff(total)
        out[list(odd)] = [len(x) for x in odd.values()]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        texts, odd = self._odd(texts)
        chunk, at = self._chunks(texts)
        n = np.diff(self.ends)[chunk]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.ends[chunk] - total[:-1], n)]
        cut = total[at].tolist()
        return [np.asarray(odd[i], np.int32) if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(cut, cut[1:]))]


ChunkCounts = ChunkIds


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkIds(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), pa.array(table.count(part.column(1).fill_null("").to_pylist()))], ["id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    text = F.col(text_col).cast("string")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).alias("id"), text.alias("text"))
    got = rows.mapInArrow(_counted(vocabulary), f"id struct<id:{kind},n_bytes:bigint>, n_tokens long")
    return got.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
