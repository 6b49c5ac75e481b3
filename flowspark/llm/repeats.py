"""Bytes of long strings that repeat across or within documents, by interval expansion on a
Burrows-Wheeler transform.

A byte is removed if it is covered by a string of `length` bytes that also starts earlier: in a
document of smaller id, or earlier in the same one. Exact, over all documents.

One transform over the whole corpus would have to be searched across machines a hundred times,
so the corpus is cut where equal strings must meet. Every window of `length` bytes has an anchor,
the run of `core` bytes in it with the least hash; equal windows have equal anchors at equal places.

1. Anchors are counted by a slot of their hash, a range of slots to a task; windows whose anchor
   occurs once repeat nowhere. A map with a bit a slot tells the rest (cost only: a shared slot
   lets a useless anchor through).
2. Each anchor that repeats is sent, with the bytes that any of its windows can hold, to the range
   of its hash. Later copies of the same bytes within a task are told at once and stay behind.
3. In a range, rows are sorted by the bytes from the anchor on, as suffixes in a suffix array are;
   the bytes before the anchors are the transform's columns. The search starts with one interval
   for each anchor, of common prefix `core`, and goes breadth first: a level puts one byte before
   all strings at once (a stable sort of each interval by that byte: the transform's last-to-first
   step), so common prefixes are derived in increasing length, core, core + 1, ... length. Intervals
   of one row end; no level beyond `length` is entered. At each level, runs whose following bytes
   fill the window up to `length` are equal windows, and all of a run but its first are repeats.

An anchor that occurs `hot` times or more (a common line, between ever other texts) is not sent
to one range: windows that it leads are told apart by all their bytes, each an anchor of its own,
and spread by their hashes. Later copies within a task stay behind here too, so a window that a
third of all documents hold arrives about once a task.

Documents are put in order by id (null first), those of one id by a hash of the text. Equal rows:
one counts as the first, the others as its copies. Null and empty texts have no bytes, shorter
ones than `length` no repeats. Extra columns are ignored. Texts have less than 2 GB.

Memory of a task: a slice of the texts or a piece of a long one, the text itself, at most SEEN strings of the bytes above, one range of
anchors. The map has a bit for every four bytes of text, MOST_BITS at most (256 MB, reached at
8 GB): beyond, more useless anchors are sent, up to 6 times the text's bytes, until executors
are given a larger map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, shuffle_partitions, small_batches, written
from .words import mix, powers, sliced, text_buffers

LENGTH, CORE, HOT = 100, 32, 50_000
LEAST_BITS, MOST_BITS = 20, 31
#: Ranges of anchors to a shuffle partition, bytes of rows held before they are sent, strings a task remembers, bytes of a slice
#: of texts and of a piece of a longer one.
RANGES, HELD, SEEN, SLICE, PIECE = 16, 1 << 24, 1 << 18, 1 << 18, 1 << 22
PAD = 0xFF  # in no UTF-8 text
_R = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint32(0xFFFFFFFF)


def _slide(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every `width` neighbours."""
    have = 1
    while have * 2 <= width:
        a, have = best(a[:-have], a[have:]), have * 2
    rest = width - have
    return best(a[: len(a) - rest], a[rest:]) if rest else a


class _Slice:
    """Anchors and window hashes of some whole texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int, core: int, starts: tuple[int, int] | None = None, shift: int = 0) -> None:
        """starts: the windows that count, where it is a piece of a text with what surrounds it; shift: its place in the text."""
        n = len(buf)
        self.shift = shift
        self.length, self.core, self.off = length, core, off
        self.buf, self.found = buf, n >= length
        if not self.found:
            return
        up, self.down = powers(n)
        self.acc = np.zeros(n + 1, np.uint64)
        np.multiply(buf.astype(np.uint64) + np.uint64(1), up, out=self.acc[1:])
        np.cumsum(self.acc[1:], out=self.acc[1:])
        self.hashes = self.hash(np.arange(n - core + 1), core)
        order = (self.hashes >> np.uint64(32)).astype(np.uint32)
        np.clip(order, 1, _NONE - np.uint32(1), out=order)
        # the least hash of every window; 0 where a window crosses documents
        self.order, width = order, length - core + 1
        self.least = _slide(order, width, np.minimum)
        for end in off[1:-1]:
            self.least[max(0, end - length + 1) : end] = 0
        if starts:
            self.least[: starts[0]] = 0
            self.least[starts[1] :] = 0
        edge = np.zeros(width - 1, np.uint32)
        led = _slide(np.concatenate((edge, self.least, edge)), width, np.maximum)
        self.places = np.flatnonzero(led == order)

    def hash(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.acc[start + size] - self.acc[start]) * self.down[start] + np.uint64(size))

    def led_by(self, places: np.ndarray) -> np.ndarray:
        """Starts of the windows whose least hash is that of one of these anchors."""
        only = np.full(len(self.order), _NONE)
        only[places] = self.order[places]
        return np.flatnonzero(_slide(only, self.length - self.core + 1, np.minimum) == self.least)

    def around(self, places: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes from `before` ahead of each place to `after` behind, PAD beyond its document; document of each)."""
        padded = np.concatenate((np.full(before, PAD, np.uint8), self.buf, np.full(after, PAD, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(padded, before + after)[places]
        doc = np.searchsorted(self.off, places, "right") - 1
        head, tail = self.off[doc] - (places - before), self.off[doc + 1] - (places - before)
        cut = np.flatnonzero((head > 0) | (tail < before + after))
        if len(cut):
            at = np.arange(before + after)
            rows[cut] = np.where((at < head[cut, None]) | (at >= tail[cut, None]), PAD, rows[cut])
        return rows, doc


def _slices(batches: Iterator[pa.RecordBatch], length: int, core: int, piece: int) -> Iterator[tuple[_Slice, np.ndarray, np.ndarray]]:
    """batches: key, tie, text. (slice, keys, ties of its texts). A text above `piece` bytes comes in pieces: each window
    counts in one of them, and a piece has around it the bytes that its windows' anchors are sent with."""
    for batch in sliced(batches, 2, min(SLICE, piece)):
        buf, off = text_buffers(batch.column(2))
        keys, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(off) > 2 or len(buf) <= piece:
            part = _Slice(buf, off, length, core)
            if part.found:
                yield part, keys, ties
            continue
        for a in range(0, len(buf), piece):
            low, high = max(0, a - length), min(len(buf), a + piece + 2 * length)
            part = _Slice(buf[low:high], np.asarray([0, high - low]), length, core, (a - low, a + piece - low), low)
            if part.found:
                yield part, keys, ties


def _count_slots(length: int, core: int, bits: int, ranges: int, piece: int):
    """For each few million anchors: (range, the slots that fall into it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def give() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held))
            at = np.searchsorted(s, (np.arange(ranges + 1, dtype=np.int64) << bits) // ranges)
            full = np.flatnonzero(at[1:] > at[:-1])
            return pa.record_batch([pa.array(full, pa.int32()), pa.array([s[at[k] : at[k + 1]].astype("<u4").tobytes() for k in full], pa.binary())], ["range", "slots"])

        for part, _, _ in _slices(batches, length, core, piece):
            held.append(_slot(part.hashes[part.places], bits))
            n += len(held[-1])
            if n >= 2_000_000:
                yield give()
                held, n = [], 0
        if n:
            yield give()

    return run


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Anchors are chosen by the upper half of their hashes, so slots come from the lower half."""
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def _ranges_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one range after another, from rows in order of their first column."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if held and row[0] != last:
                yield held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield held


def _repeated_slots(hot: int):
    """(first byte, bits) of the map of slots that occur twice or more; (slot, null) of those that occur `hot` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _ranges_in_turn(batches):
            slot, n = np.unique(np.concatenate([np.frombuffer(b, "<u4") for _, b in rows]).astype(np.int64), return_counts=True)
            many = slot[n >= hot]
            yield pa.record_batch([pa.array(many), pa.nulls(len(many), pa.binary())], ["at", "bits"])
            slot = slot[n >= 2]
            if len(slot):
                first = int(slot[0]) & ~7
                bits = np.zeros((int(slot[-1]) | 7) + 1 - first, bool)
                bits[slot - first] = True
                yield pa.record_batch([pa.array([first >> 3]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["at", "bits"])

    return run


class _Seen:
    """Hashes of strings that a task has met, with the first place of each; forgets all beyond SEEN."""

    def __init__(self) -> None:
        self.h = np.zeros(0, np.uint64)
        self.at = np.zeros((3, 0), np.int64)

    def told(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """at: key, tie and position of each. 0: the very same place again, 1: to be sent, 2: a later copy."""
        out = np.zeros(len(h), np.int8)
        order = np.lexsort((at[2], at[1], at[0], h))
        hs, ats = h[order], at[:, order]
        begins = np.concatenate(([True], hs[1:] != hs[:-1]))
        lead = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        out[order] = np.where((ats == ats[:, lead]).all(0), 0, 2)
        first = order[begins]
        if len(self.h) > SEEN:
            self.__init__()
        place = np.searchsorted(self.h, h[first])
        known = np.zeros(len(first), bool)
        if len(self.h):
            known = self.h[np.minimum(place, len(self.h) - 1)] == h[first]
        mine, theirs = at[:, first[known]], self.at[:, place[known]]
        less = _less(mine, theirs)
        out[first[known]] = np.where(less, 1, np.where((mine == theirs).all(0), 0, 2))
        self.at[:, place[known][less]] = mine[:, less]
        new = first[~known]
        out[new] = 1
        self.h, self.at = np.insert(self.h, place[~known], h[new]), np.insert(self.at, place[~known], at[:, new], axis=1)
        return out


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


_SENT = "range int, width int, rows binary, key long, tie long, span long"
_NAMES = ["range", "width", "rows", "key", "tie", "span"]


def _spans(key: np.ndarray, tie: np.ndarray, start: np.ndarray, stop: np.ndarray, where: np.ndarray | int = 0) -> pa.RecordBatch:
    """Removed spans as rows of the same schema; a span is start and stop in one number."""
    n = len(key)
    at = where if isinstance(where, np.ndarray) else np.full(n, where)
    return pa.record_batch([pa.array(at, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(key), pa.array(tie), pa.array((start.astype(np.int64) << 32) | stop.astype(np.int64))], _NAMES)


def _pack(key: np.ndarray, tie: np.ndarray, pos: np.ndarray, rows: np.ndarray) -> bytes:
    raw = b"".join((key.astype("<i8").tobytes(), tie.astype("<i8").tobytes(), pos.astype("<i8").tobytes(), rows.tobytes()))
    return len(key).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * (24 + width), codec="zstd", asbytes=True), np.uint8)
    key, tie, pos = raw[: 24 * n].view("<i8").reshape(3, n)
    return key, tie, pos, raw[24 * n :].reshape(n, width)


def _send(length: int, core: int, bits: int, ranges: int, piece: int, shared):
    """Rows of anchors that repeat, by range, and spans of copies that are told already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = shared.value
        before = length - core
        held: dict[int, list] = {before + length: [], length: []}
        seen = {width: _Seen() for width in held}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for width, parts in held.items():
                if not parts:
                    continue
                h, key, tie, pos, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
                where = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(where, kind="stable")
                at = np.searchsorted(where[order], np.arange(ranges + 1))
                full = np.flatnonzero(at[1:] > at[:-1])
                blobs = [_pack(*(x[order[at[k] : at[k + 1]]] for x in (key, tie, pos, rows))) for k in full]
                n = len(full)
                yield pa.record_batch([pa.array(full, pa.int32()), pa.array(np.full(n, width), pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(n, pa.int64())] * 3], _NAMES)
                parts.clear()

        for part, keys, ties in _slices(batches, length, core, piece):
            slot = _slot(part.hashes[part.places], bits)
            keep = (repeated[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) == 1
            common = np.isin(slot, hot) if len(hot) else np.zeros(len(slot), bool)
            found = [(part.places[keep & ~common], before, part.core)]
            if common.any():
                found.append((part.led_by(part.places[common]), 0, length))
            for places, ahead, whole in found:
                if not len(places):
                    continue
                rows, doc = part.around(places, ahead, length)
                start = np.maximum(places - ahead, part.off[doc])
                stop = np.minimum(places + length, part.off[doc + 1])
                head = mix((part.acc[stop] - part.acc[start]) * part.down[start] + mix(((places - start) << 32 | (stop - places)).astype(np.uint64)))
                at = np.stack((keys[doc], ties[doc], places - part.off[doc] + part.shift))
                told = seen[ahead + length].told(head, at)
                new, copies = np.flatnonzero(told == 1), np.flatnonzero(told == 2)
                h = part.hashes[places[new]] * _ODD if ahead else part.hash(places[new], whole)
                held[ahead + length].append((h ^ (h >> np.uint64(32)), at[0, new], at[1, new], at[2, new], rows[new]))
                size += len(new) * (ahead + length + 32)
                if len(copies):
                    base = part.off[doc[copies]] - part.shift
                    yield _spans(at[0, copies], at[1, copies], start[copies] - base, stop[copies] - base, at[2, copies] % ranges)
            if size >= HELD:
                yield from give()
                size = 0
        yield from give()

    return run


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of big-endian numbers: rows are in order where the columns are."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    return np.ascontiguousarray(wide.view(">u8").T.astype(np.uint64))


def _ranks(at: np.ndarray) -> np.ndarray:
    """Order of places (key, tie, position); equal ones rank alike."""
    order = np.lexsort(at[::-1])
    s = at[:, order]
    out = np.empty(at.shape[1], np.int64)
    out[order] = np.cumsum(np.concatenate(([0], (s[:, 1:] != s[:, :-1]).any(0))))
    return out


def repeated_windows(rows: np.ndarray, rank: np.ndarray, length: int, core: int) -> np.ndarray:
    """rows: `length` - `core` bytes before an anchor, the anchor, as many bytes behind (PAD beyond a text);
    rank: order of the rows' places. For each row and each number of bytes taken before the anchor
    (0 to `length` - `core`): whether that window of `length` bytes occurs at a lesser rank."""
    before = length - core
    out = np.zeros((len(rows), before + 1), bool)
    order = np.lexsort(_words(rows[:, before:])[::-1])  # suffixes that start at anchors
    tail = rows[order, before:]
    differ = tail[1:] != tail[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), length)  # common prefix of neighbours
    ends = (tail == PAD).argmax(1)
    room = np.where((tail == PAD).any(1), ends, length)
    columns = np.ascontiguousarray(rows[order, :before].T)  # the transform: what stands before each suffix
    rank = rank[order]
    del tail, differ

    active = np.arange(len(rows))
    interval = np.concatenate(([0], np.cumsum(prefix < core)))
    for taken in range(before + 1):
        # intervals of one row end
        begins = np.concatenate(([True], interval[1:] != interval[:-1])) if len(interval) else np.zeros(0, bool)
        last = np.concatenate((begins[1:], [True])) if len(interval) else begins
        active, interval = active[~(begins & last)], interval[~(begins & last)]
        if not len(active):
            break
        # runs of an interval whose bytes behind fill the window
        full = room[active] >= length - taken
        a, i = active[full], interval[full]
        if len(a):
            like = np.concatenate(([0], np.cumsum(prefix < length - taken)))[a]
            begins = np.concatenate(([True], (i[1:] != i[:-1]) | (like[1:] != like[:-1])))
            first = np.minimum.reduceat(rank[a], np.flatnonzero(begins))[np.cumsum(begins) - 1]
            out[a[rank[a] != first], taken] = True
        if taken == before:
            break
        # one byte more before all strings
        byte = columns[before - 1 - taken][active]
        inside = byte != PAD
        active = active[inside]
        by = interval[inside] * 256 + byte[inside]
        move = np.argsort(by, kind="stable")
        active, interval = active[move], by[move]
    back = np.empty_like(out)
    back[order] = out
    return back


def _removed(at: np.ndarray, rows: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of the repeats among the rows of one range; at: their key, tie and position."""
    width = rows.shape[1]
    before = width - length
    core = length - before
    rank = _ranks(at)
    # equal rows: only the first goes on, for the others all windows repeat
    h = np.zeros(len(rows), np.uint64)
    for w in _words(rows):
        h = (h ^ w) * _R
        h ^= h >> np.uint64(29)
    order = np.lexsort((rank, h))
    begins = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    lead = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    same = np.zeros(len(rows), bool)
    later = np.flatnonzero(~begins)
    same[order[later]] = (rows[order[later]] == rows[lead[later]]).all(1)
    removed = np.zeros((len(rows), before + 1), bool)
    head = (rows[:, :before] != PAD).sum(1)
    room = np.where((rows[:, before:] == PAD).any(1), (rows[:, before:] == PAD).argmax(1), length)
    first = np.empty(len(rows), np.int64)
    first[order] = rank[lead]
    taken = np.arange(before + 1)
    copies = same & (rank != first)
    removed[copies] = (taken <= head[copies, None]) & (taken >= length - room[copies, None])
    left = np.flatnonzero(~same)
    if before:
        removed[left] = repeated_windows(rows[left], rank[left], length, core)
    # windows that start at neighbouring bytes make one span
    edge = np.diff(removed.astype(np.int8), axis=1, prepend=0, append=0)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    pos = at[2, row]
    return _spans(at[0, row], at[1, row], pos - high, pos - low + length)


def _search(length: int):
    """All ranges of a partition in turn, and spans that are told already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        last = None

        def give() -> Iterator[pa.RecordBatch]:
            for width in sorted(held):
                key, tie, pos, rows = (np.concatenate(x) for x in zip(*(_unpack(b, width) for b in held[width]), strict=True))
                yield _removed(np.stack((key, tie, pos)), rows, length).select(["key", "tie", "span"])
            held.clear()

        for batch in batches:
            known = batch.filter(batch.column(5).is_valid())
            if known.num_rows:
                yield known.select(["key", "tie", "span"])
            sent = batch.filter(batch.column(2).is_valid())
            for where, width, blob in zip(*(sent.column(i).to_pylist() for i in range(3)), strict=True):
                if where != last:
                    yield from give()
                    last = where
                held.setdefault(width, []).append(blob)
        yield from give()

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(column(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"), column(id_col).alias("id"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(key, tie, span): spans to remove, start << 32 | stop in bytes, overlapping ones included; key: the id
    (null: the least long), tie: xxhash64 of the text. Copies of whole rows are not told here."""
    if not 0 < core < length:
        raise ValueError("core must be shorter than length")
    spark = docs.sparkSession
    texts = _keyed(docs, id_col, text_col).select("key", "tie", "text")
    total = docs.agg(F.sum(F.octet_length(column(text_col).cast("string")))).first()[0] or 0
    bits = min(max(int(total // 4).bit_length(), LEAST_BITS), MOST_BITS)
    parts = shuffle_partitions(spark)
    ranges = RANGES * parts
    with small_batches(spark):
        slots = texts.mapInArrow(_count_slots(length, core, bits, ranges, piece), "range int, slots binary").repartition(parts, "range").sortWithinPartitions("range")
        got = slots.mapInArrow(_repeated_slots(hot), "at long, bits binary").toArrow()
        repeated = np.zeros(1 << (bits - 3), np.uint8)
        at = got["at"].to_numpy()
        valid = got["bits"].is_valid().to_numpy()
        for i in np.flatnonzero(valid):
            bytes_ = np.frombuffer(got["bits"][int(i)].as_py(), np.uint8)
            repeated[at[i] : at[i] + len(bytes_)] |= bytes_
        shared = spark.sparkContext.broadcast((repeated, np.sort(at[~valid])))
        sent = texts.mapInArrow(_send(length, core, bits, ranges, piece, shared), _SENT).repartition(parts, "range").sortWithinPartitions("range")
        return written(sent.mapInArrow(_search(length), "key long, tie long, span long"), "spans")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 3):
        spans, kept = [], []
        for text, packed in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
            data = text.encode()
            s = np.sort(packed.values.to_numpy()) if packed.is_valid else np.zeros(0, np.int64)
            start, stop = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF) if len(s) else s
            first = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1]))) if len(s) else s
            start, stop = start[first], stop[np.concatenate((first[1:] - 1, [len(s) - 1]))] if len(s) else s
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(start, stop, strict=True)])
            edge = [0, *np.stack((start, stop), 1).ravel().tolist(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
        n_bytes = pc.binary_length(batch.column(3).cast(pa.large_binary())).cast(pa.int64())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), n_bytes, pa.array(spans, kind), pa.array(kept, pa.binary())], ["key", "tie", "id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, spans (array of start and stop of removed runs), kept (the bytes that remain)."""
    spans = repeated_spans(docs, length, core, hot, id_col, text_col, piece)
    rows = _keyed(docs, id_col, text_col)
    packed = spans.groupBy("key", "tie").agg(F.collect_list("span").alias("packed"))
    kind = docs.select(column(id_col)).dtypes[0][1]
    joined = rows.select("key", "tie", "id", "text").join(packed.hint("shuffle_hash"), ["key", "tie"], "left")
    schema = f"key long, tie long, id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    out = joined.select("key", "tie", "id", "text", "packed").mapInArrow(_keep, schema)
    # equal rows: the first is as it is, the others are copies of it
    many = written(rows.groupBy("key", "tie").count().where("count > 1"), "copies")
    if not many.isEmpty():
        once = out.join(many.hint("shuffle_hash"), ["key", "tie"], "left_anti")
        one = out.join(many.hint("shuffle_hash"), ["key", "tie"]).groupBy("key", "tie", "count").agg(*[F.first(c).alias(c) for c in ("id", "n_bytes", "spans", "kept")])
        copy = one.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("place"))
        whole = (F.col("place") > 1) & (F.col("n_bytes") >= length)
        copy = copy.withColumn("spans", F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.col("spans")))
        copy = copy.withColumn("kept", F.when(whole, F.lit(b"")).otherwise(F.col("kept")))
        out = once.select("id", "n_bytes", "spans", "kept").unionByName(copy.select("id", "n_bytes", "spans", "kept"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")


def repeats_digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of what remove_repeats gives."""
    kept = F.col("kept")
    return rows.select(
        column(id_col), "n_bytes", (F.col("n_bytes") - F.length(kept)).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"),
    )
