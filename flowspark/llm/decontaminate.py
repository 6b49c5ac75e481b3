"""Benchmark items found in training texts: BM25 over an inverted index of the items, with
block-max WAND, then verification of question and answer.

Items are short and few beside the corpus: they come to the driver in blocks of
ITEM_BLOCK rows, and the texts are searched once per block; what a block found is written before the next one is
broadcast, so that one index is held at a time, however many items there are. Terms are pairs of adjacent words
(single words occur in most items by chance, so that their bounds rule nothing out). A text is
one query of its distinct terms, so that neither the length of an item nor the places of its
parts matter. First every text gets its upper bound,
the sum of the largest impacts of its terms, vectorised over all texts; only those
that could reach the threshold go through the postings: the largest impacts of their blocks
rule out blocks, then documents, before full scores are computed. All items above the
threshold (a share of the item's score for itself, or the least score of a text that passes the
verification, if that is lower) are candidates, and each is verified on
the whole text: the shares of the five-word shingles of the first half of the item (the
question) and of the second (the answer) that the text holds.

Null texts are empty texts. Items without words are never found. Repeated rows of texts are searched each.
Rows of items with the same id are one item: its terms and its halves are those of all of them, a shingle counting
once for each row and half that holds it. Items without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, union_all, written
from .words import _GAP, mix, shingle_hashes, slices, text_buffers, word_hashes

ITEM_BLOCK, POSTINGS = 20_000, 32
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, EITHER = 0.3, 0.6, 0.3


class ItemIndex:
    """Postings (item, impact) by word in item order, with the largest impact of each block of POSTINGS."""

    def __init__(self, ids: list[int], texts: list[str | None], threshold: float = THRESHOLD) -> None:
        self.ids, owner = np.unique(np.asarray(ids, np.int64), return_inverse=True)
        buf, off = text_buffers(pa.array(texts, pa.string()))
        h, _, _, at = word_hashes(buf, off)
        rows_of: list[list[int]] = [[] for _ in self.ids]
        for row, i in enumerate(owner.tolist()):
            rows_of[i].append(row)
        bags = [shingle_hashes(h[at[r] : at[r + 1]], 2) for r in range(len(ids))]
        terms = [np.concatenate([bags[r] for r in of]) for of in rows_of]
        self.words = np.unique(np.concatenate(terms)) if terms else h
        n = len(self.ids)
        mean = max(1.0, sum(map(len, terms)) / max(n, 1))
        rows = []
        for i, bag in enumerate(terms):
            w, c = np.unique(bag, return_counts=True)
            rows.append((np.searchsorted(self.words, w), np.full(len(w), i), c / (c + K1 * (1 - B + B * len(bag) / mean)) * (K1 + 1)))
        t, item, tf = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, int) for k in range(3))
        df = np.bincount(t, minlength=len(self.words))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        order = np.lexsort((item, t))
        t, self.item, self.impact = t[order], item[order].astype(np.int64), (tf * idf[t])[order]
        self.begin = np.concatenate(([0], np.cumsum(df)))
        self.most = np.zeros(len(self.words))
        np.maximum.at(self.most, t, self.impact)
        self.blocks = [[(a, min(a + POSTINGS, e), float(self.impact[a : min(a + POSTINGS, e)].max())) for a in range(s, e, POSTINGS)] for s, e in zip(self.begin[:-1].tolist(), self.begin[1:].tolist())]
        own = np.zeros(n)
        np.add.at(own, self.item, self.impact)
        self.parts = []
        passing = np.zeros(n)
        for i, of in enumerate(rows_of):
            shingles = [shingle_hashes(h[at[r] : at[r + 1]]) for r in of]
            cut = [(len(s) + 1) // 2 for s in shingles]
            first = [np.unique(s[:half]) for s, half in zip(shingles, cut)]
            second = [np.unique(s[half:] if len(s) > 1 else s) for s, half in zip(shingles, cut)]
            self.parts.append((np.concatenate(first), np.concatenate(second)))
            passing[i] = self._passing(i, shingles, [bags[r] for r in of], own[i])
        # the slack covers rounding: sums are made in different orders
        self.enough = np.minimum(threshold * own, passing) * (1 - 1e-6)
        self.least = float(self.enough[own > 0].min()) if (own > 0).any() else np.inf

    def _passing(self, i: int, shingles: list[np.ndarray], bags: list[np.ndarray], own: float) -> float:
        """No text that holds OVERLAP of the item's shingles scores less for it. shingles, bags: those of each row of the item.

        Each place of a term has an equal part of the term's impact; a place lies in as many shingles as a
        shingle has terms at most (twice as many where a row has one shingle, which is in both halves), so the held
        shingles' places, summed, count it no more often.
        """
        if sum(map(len, shingles)) < 2:
            return own
        w, c = np.unique(np.concatenate(bags), return_counts=True)
        t = np.searchsorted(self.words, w)
        impact = np.asarray([self.impact[a + np.searchsorted(self.item[a:e], i)] for a, e in zip(self.begin[t], self.begin[t + 1])])
        light, often = [], 1
        for s, bag in zip(shingles, bags):
            if not len(s):
                continue
            part = (impact / c)[np.searchsorted(w, bag)]
            size = len(bag) - len(s) + 1
            run = np.cumsum(np.concatenate(([0.0], part)))
            weight = run[size:] - run[:-size]
            half = (len(s) + 1) // 2 if len(s) > 1 else 0
            often = max(often, size if len(s) > 1 else 2 * size)
            # a shingle counts with its lightest place, once for each half that holds it
            for x, y in ((s[:half], weight[:half]), (s[half:], weight[half:])) if half else ((s, weight), (s, weight)):
                _, k = np.unique(x, return_inverse=True)
                least = np.full(k.max() + 1, np.inf)
                np.minimum.at(least, k, y)
                light.append(least)
        every = np.sort(np.concatenate(light))
        return float(every[: int(np.ceil(OVERLAP * len(every) - 1e-9))].sum()) / often

    def candidates(self, terms: np.ndarray) -> set[int]:
        """Items whose BM25 score for the query words is above their threshold (block-max WAND)."""
        terms = terms[np.argsort(-self.most[terms])]
        rest = np.concatenate((np.cumsum(self.most[terms][::-1])[::-1], [0.0]))
        # an item must occur with one of the leading words: the others together stay below the threshold
        lead = int(np.count_nonzero(rest >= self.least))
        found: set[int] = set()
        for k in range(lead):
            for a, e, most in self.blocks[terms[k]]:
                if most + rest[k + 1] >= self.least:  # of items whose first leading word is this one
                    found.update(self.item[a:e].tolist())
        if not found:
            return found
        items = np.asarray(sorted(found))
        begin, n = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        score = np.bincount(self.item[at], self.impact[at], minlength=len(self.ids))[items]
        return set(items[score >= self.enough[items]].tolist())


def _pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each word with the next one, as shingle_hashes(words of a text, 2) has them; 0 at the last word of a text."""
    pair = np.full(len(h), np.uint64(2)) + h * _GAP[0]
    pair[:-1] += h[1:] * _GAP[1]
    pair = mix(pair)
    n = np.diff(at)
    pair[at[1:][n > 0] - 1] = 0
    single = at[:-1][n == 1]
    pair[single] = mix(np.uint64(1) + h[single] * _GAP[0])
    return pair


def _text_terms(term: np.ndarray, start: int, end: int) -> np.ndarray:
    t = term[start:end]
    return np.unique(t[t >= 0])


def _holds(own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in own (sorted, not empty)."""
    return own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x


def _found(items: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(place of the text, place of the item, question, answer, overlap) for what shares shingles."""
    for lo, hi in slices(texts):
        buf, off = text_buffers(texts.slice(lo, hi - lo))
        h, _, _, at = word_hashes(buf, off)
        if not len(h) or not len(items.words):
            continue
        pair = _pairs(h, at)
        term = np.minimum(np.searchsorted(items.words, pair), len(items.words) - 1)
        term = np.where(items.words[term] == pair, term, -1)
        # upper bounds: a repeated word counts again, which only raises them
        bound = np.concatenate(([0.0], np.cumsum(np.where(term >= 0, items.most[term], 0.0))))
        hits: dict[int, set[int]] = {}
        for d in np.flatnonzero(bound[at[1:]] - bound[at[:-1]] >= items.least * (1 - 1e-6)).tolist():
            terms = _text_terms(term, at[d], at[d + 1])
            if items.most[terms].sum() >= items.least and (got := items.candidates(terms)):
                hits[d] = got
        for d, found in hits.items():
            own = np.unique(shingle_hashes(h[at[d] : at[d + 1]]))
            for i in sorted(found):
                q, a = (_holds(own, x) for x in items.parts[i])
                if q.any() or a.any():
                    yield lo + d, i, float(q.mean()), float(a.mean()), float(np.concatenate((q, a)).mean())


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[d].as_py(), int(items.ids[i]), q, a, both) for d, i, q, a, both in _found(items, batch.column(1))]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), *[pa.float64()] * 3))], ["id", "item_id", "question", "answer", "overlap"])

    return run


def _leaked(question, answer, overlap):
    return (overlap >= OVERLAP) & (question >= EITHER) & (answer >= EITHER)


def item_blocks(items: DataFrame, item_col: str, text_col: str, size: int | None = None) -> Iterator[tuple[list[tuple[int, str | None]], bool]]:
    """The items in blocks of `size` rows (ITEM_BLOCK), in id order, and whether the block is the last; rows of an id stay together."""
    size = size or ITEM_BLOCK
    block: list[tuple[int, str | None]] = []
    rows = items.select(column(item_col).cast("long").alias("item"), column(text_col).cast("string").alias("text"))
    for r in rows.where("item IS NOT NULL").orderBy("item", "text").toLocalIterator():
        if len(block) >= size and r[0] != block[-1][0]:
            yield block, False
            block = []
        block.append((r[0], r[1]))
    if block:
        yield block, True


def benchmark_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, question, answer, overlap, leaked): the items that a text shares shingles
    with, among those that BM25 finds for it. question, answer, overlap: shares of
    the item's shingles. leaked: overlap >= OVERLAP and both halves >= EITHER."""
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    schema = "id long, item_id long, question double, answer double, overlap double"
    found = []
    for block, last in item_blocks(items, item_col, item_text):
        index = _broadcast(docs, block)
        hits = rows.mapInArrow(_search(index), schema)
        found.append(hits if last else written(hits, "overlaps"))
        if not last:
            index.destroy()
    pairs = union_all(found) if found else docs.sparkSession.createDataFrame([], schema)
    leaked = _leaked(F.col("question"), F.col("answer"), F.col("overlap"))
    return pairs.select(column("id").alias(id_col), "item_id", "question", "answer", "overlap", leaked.alias("leaked"))


def leaked_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_items, items, overlap) of the texts that leak an item; items: their ids, ascending."""
    pairs = benchmark_overlaps(docs, items, id_col, text_col).where("leaked")
    return pairs.groupBy(column(id_col)).agg(F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("items"), F.max("overlap").alias("overlap"))


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows and columns of docs whose text leaks no item; texts are not shuffled."""
    for block, last in item_blocks(items, item_col, item_text):
        index = _broadcast(docs, block)
        docs = docs.where(~_leaks(index)(column(text_col).cast("string")))
        if not last:
            docs = written(docs, "unleaked")
            index.destroy()
    return docs


def _broadcast(docs: DataFrame, block: list[tuple[int, str | None]]):
    return docs.sparkSession.sparkContext.broadcast(ItemIndex([i for i, _ in block], [t for _, t in block]))


def _leaks(index):
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for d, _, q, a, both in _found(index.value, texts):
            out[d] |= _leaked(q, a, both)
        return pa.array(out)

    return leaks
