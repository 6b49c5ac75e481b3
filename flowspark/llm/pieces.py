"""SentencePiece encoding and decoding through tables of distinct chunks.

Where no piece of a model crosses from a character to a whitespace marker, a text is
segmented chunk by chunk: a chunk is a word with the markers before it. Each task keeps a
table of the distinct chunks it has met, segments each of them once with the library, and
joins the ids back to the texts by position, vectorised over a few MB of text. The table
holds at most TABLE chunks and starts anew beyond, so memory is bounded. A model with
pieces that cross markers, or with a normaliser other than identity, is refused.

Null texts are empty texts: only the begin and end ids. Very long texts are whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

MARK = "▁"
TABLE = 200_000
_CHUNK = re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+\Z")


@functools.lru_cache(maxsize=2)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
    # every kind of character that a Unicode normal form would change, and spaces in all places
    probes = ["a  b ﬁ Á ① ｱ Å ² ", "  x", "\t x\u3000y\u00a0", *(chr(c) for c in range(0x80, 0x2FA20) if unicodedata.normalize("NFKC", chr(c)) != chr(c))]
    changed = [p for p in probes if sp.normalize(p) != MARK + p.replace(" ", MARK)]
    if crossing or changed or "".join(sp.encode_as_pieces("  x")) != MARK * 3 + "x":
        raise ValueError(f"pieces of {model} cross whitespace markers ({crossing[:3]}), or it normalises texts ({changed[:3]})")
    return sp


class ChunkTable:
    """Distinct chunks (without their first marker) and their ids."""

    def __init__(self, model: str) -> None:
        self.sp = processor(model)
        self.mark = self.sp.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # all ids, and where those of each chunk end

    def ragged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offsets of the texts (one more than texts); no begin or end ids."""
        if len(self.index) > TABLE:
            self.clear()
        chunks: list[str] = []
        at = [0]
        for t in texts:
            if t:
                if "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                    chunks += [c[1:] for c in _CHUNK.findall(" " + t)]
                else:
                    chunks += t.split(" ")
            at.append(len(chunks))
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        if new:
            found = [ids if c else [self.mark] for c, ids in zip(new, self.sp.encode(new, num_threads=1))]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.pool = np.concatenate((self.pool, np.asarray([i for ids in found for i in ids], np.int32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(list(map(len, found)))))
        where = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        begin = self.ends[:-1]
        length = np.diff(self.ends)
        n = length[where]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(ends[-1]) + np.repeat(begin[where] - ends[:-1], n)]
        return ids, ends[np.asarray(at)]


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encoded_texts(table: ChunkTable, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text with begin and end ids."""
    ids, at = table.ragged(texts)
    first, last = np.asarray([table.sp.bos_id()], np.int32), np.asarray([table.sp.eos_id()], np.int32)
    return [np.concatenate((first, ids[a:b], last)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                own = encoded_texts(table, part.column(1).fill_null("").to_pylist())
                at = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                yield pa.record_batch([part.column(0), _lists(np.concatenate(own), at)], ["id", "ids"])

    return run


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            text = [sp.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    return run


def _digest(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                n, hashed, back = [], [], []
                for ids in encoded_texts(table, part.column(1).fill_null("").to_pylist()):
                    n.append(len(ids))
                    hashed.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(table.sp.decode(ids.tolist()).encode()).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(hashed), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _both(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                own = encoded_texts(table, part.column(1).fill_null("").to_pylist())
                n = [len(x) for x in own]
                back = [table.sp.decode(x.tolist()) for x in own]
                yield pa.record_batch([part.column(0), _lists(np.concatenate(own), np.concatenate(([0], np.cumsum(n)))), pa.array(n, pa.int64()), pa.array(back, pa.string())], ["id", "ids", "n_tokens", "text"])

    return run


def _rows(df: DataFrame, id_col: str, col: str, kind: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.col(col).cast(kind).alias("value"))
    return rows, f"id {dict(rows.dtypes)['id']}"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and ids, with begin and end ids."""
    rows, kind = _rows(docs, id_col, text_col, "string")
    return rows.mapInArrow(_encode(model), f"{kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id_col and the decoded text; null ids give a null text."""
    rows, kind = _rows(encoded, id_col, ids_col, "array<int>")
    return rows.mapInArrow(_decode(model), f"{kind}, text string").select(F.col("id").alias(id_col), "text")


def round_trip_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode, then decode, in one pass: number of ids, hash of the ids, hash of the decoded text."""
    rows, kind = _rows(docs, id_col, text_col, "string")
    got = rows.mapInArrow(_digest(model), f"{kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return got.withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, ids, n_tokens, and the text decoded from the ids, in one pass."""
    rows, kind = _rows(docs, id_col, text_col, "string")
    return rows.mapInArrow(_both(model), f"{kind}, ids array<int>, n_tokens long, text string").withColumnRenamed("id", id_col)
