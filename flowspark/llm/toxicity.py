"""Toxicity of texts by votes of the nearest labelled examples.

Examples are a bounded sample of the labelled texts (`examples`, half of it toxic where there
are enough); a vote counts by the share of its class that is in the sample. The vectors hold every word with its
TF-IDF, idf counted in all texts, times how much it tells: the size of the logarithm of its odds in toxic against
other labelled texts, all of them, smoothed by SMOOTH texts in the true ratio. Words that tell clean texts weigh as
well as those that tell toxic ones, no word is left out, and one that no labelled text holds tells nothing. The k nearest by exact cosine come from an inverted index with block maxima: the postings of
rare words give their part of all scores, the largest values of common words in each block of examples
bound the rest, and only blocks that can hold one of the k are scored in full. The score is the vote of the k nearest,
weighted by cosine, drawn towards the base rate when they are few or far.

Null texts are empty texts; a text without words has no neighbours and the score of the base rate. Null labels
are not used. Without labelled texts of both classes all scores are 0. Repeated rows are
scored each; ties between neighbours go to the smaller id. An id with several labels is toxic if any of them
says so; of several texts with one id the first in order of text is the example.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import Sieve, column, small_batches, written
from .words import slices, span_hashes, text_buffers, word_hashes

EXAMPLES, NEIGHBOURS, BLOCK, PRIOR, SMOOTH, DENSE = 4000, 15, 64, 0.2, 5.0, 2048
#: Examples to a block, of whose common words the largest values are known.
EXAMPLE_BLOCK = 128
_TRIM = np.zeros(256, bool)
_TRIM[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Words of more bytes also count by their first so many.
STEMS = (6, 7)


def _bags(column: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each text the distinct hashes of its words and stems and their counts, a few MB of text at a time.

    ASCII marks count as spaces.
    """
    for a, b in slices(column):
        buf, off = text_buffers(column.slice(a, b - a))
        buf = np.where(_TRIM[buf], np.uint8(32), buf)
        h, start, stop, at = word_hashes(buf, off)
        hashes = span_hashes(buf)
        terms, owner = [h], [np.arange(len(h))]
        for n in STEMS:
            long = np.flatnonzero(stop - start > n)
            terms.append(hashes(start[long], start[long] + n) + np.uint64(n))
            owner.append(long)
        terms, owner = np.concatenate(terms), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        terms, cut = terms[order], np.searchsorted(owner[order], at)
        yield [np.unique(terms[cut[i] : cut[i + 1]], return_counts=True) for i in range(b - a)]


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text): id, word, n."""
    for batch in batches:
        done = 0
        for bags in _bags(batch.column(1)):
            ids = np.repeat(batch.column(0).slice(done, len(bags)).to_numpy(), [len(w) for w, _ in bags])
            done += len(bags)
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([w for w, _ in bags]).astype(np.int64)), pa.array(np.concatenate([c for _, c in bags]).astype(np.int64))], ["id", "word", "n"])


def _class_counts(words):
    """Of rows (label, text): in how many toxic texts, and in how many, each of the given words is; word -1: all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        a, n = np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            done = 0
            for bags in _bags(batch.column(1)):
                label = batch.column(0).slice(done, len(bags)).to_numpy()
                done += len(bags)
                flat, toxic = np.concatenate([w for w, _ in bags]), np.repeat(label, [len(w) for w, _ in bags])
                at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                own = known[at] == flat if len(known) else np.zeros(len(flat), bool)
                n += np.bincount(at[own], minlength=len(n))
                a += np.bincount(at[own & (toxic == 1)], minlength=len(a))
                n[-1] += len(bags)
                a[-1] += int(label.sum())
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.where(some == len(known), -1, some).astype(np.int32)), pa.array(a[some]), pa.array(n[some])], ["word", "a", "n"])

    return run


def _passing(sieve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            yield batch.filter(pa.array(sieve.value.passes(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))

    return run


def telling(a: np.ndarray, n: np.ndarray, pos: int, rest: int, smooth: float = SMOOTH) -> np.ndarray:
    """The size of the log-odds of words that are in n labelled texts, a of them toxic; pos and rest: toxic and other texts."""
    base = pos / max(pos + rest, 1)
    up, down = a + smooth * base, n - a + smooth * (1 - base)
    return np.abs(np.log(up / (pos + smooth * base)) - np.log(down / (rest + smooth * (1 - base))))


def _frequencies(words):
    """How many texts hold each of the given words: one row per word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        total, rows = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for bags in _bags(batch.column(0)):
                rows += len(bags)
                flat = np.concatenate([w for w, _ in bags])
                at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                if len(known):
                    total += np.bincount(at[known[at] == flat], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *some.tolist()], pa.int32()), pa.array([rows, *total[some].tolist()], pa.int64())], ["word", "n"])

    return run


class NearestExamples:
    """An inverted index of the examples' weighted TF-IDF vectors, and their labels.

    share: what a word's weight is multiplied by. unseen: the weight of a word that no example holds.
    votes: what a vote for 0 and for 1 counts.
    """

    def __init__(self, words: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray], base: float, k: int = NEIGHBOURS, share: np.ndarray | None = None, unseen: float = 0.0, votes: tuple[float, float] = (1.0, 1.0)) -> None:
        self.words, self.idf, self.base, self.k, self.unseen = words, idf, base, k, unseen
        self.ids, self.labels = ids, labels.astype(float)
        self.votes = np.where(self.labels == 1, votes[1], votes[0])
        self.weight = idf if share is None else idf * share
        order = np.lexsort((at[1], at[0]))
        t, self.item = at[0][order], at[1][order].astype(np.int32)
        value = (1 + np.log(at[2][order])) * self.weight[t]
        norm = np.sqrt(np.bincount(self.item, value**2, minlength=len(ids)))
        self.value = (value / np.where(norm > 0, norm, 1.0)[self.item]).astype(np.float32)
        n = np.bincount(t, minlength=len(words))
        self.begin = np.concatenate(([0], np.cumsum(n)))
        common = np.argsort(-n, kind="stable")[:DENSE]
        common = np.sort(common[n[common] * 16 >= max(len(ids), 1)])
        self.row = np.full(len(words), -1)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), len(ids)), np.float32)
        held = self.row[t] >= 0
        self.common[self.row[t[held]], self.item[held]] = self.value[held]
        # the largest value of each common word in each block of examples
        self.n_blocks = -(-len(ids) // EXAMPLE_BLOCK)
        self.common_most = self._most(self.common)

    def _most(self, x: np.ndarray) -> np.ndarray:
        """The largest value of each row in each block of examples."""
        out = np.zeros((len(x), self.n_blocks * EXAMPLE_BLOCK), x.dtype)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.n_blocks, EXAMPLE_BLOCK).max(axis=2)

    @property
    def weights(self) -> np.ndarray:
        """The whole matrix, words by examples."""
        out = np.zeros((len(self.words), len(self.ids)), np.float32)
        out[np.repeat(np.arange(len(self.words)), np.diff(self.begin)), self.item] = self.value
        return out

    def nearest(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest examples, the nearest first."""
        return self.nearest_of([(words, counts)])[0]

    def nearest_of(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for each of a few texts."""
        size, most = len(self.ids), min(self.k, len(self.ids))
        if not size or not len(self.words):
            return [(np.zeros(0), np.zeros(0, int)) for _ in bags]
        text = np.repeat(np.arange(len(bags)), [len(w) for w, _ in bags])
        flat, counts = (np.concatenate([x[i] for x in bags]) for i in (0, 1))
        t = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        hit = self.words[t] == flat
        q = (1 + np.log(counts)) * np.where(hit, self.weight[t], self.unseen)
        norm = np.sqrt(np.bincount(text, q**2, minlength=len(bags)))
        t, q, text = t[hit], q[hit], text[hit]
        dense = self.row[t] >= 0
        matrix = np.zeros((len(bags), len(self.common)), np.float32)
        matrix[text[dense], self.row[t[dense]]] = q[dense]
        # the postings of other words are short: their part of every score is exact
        t, q, text = t[~dense], q[~dense], text[~dense]
        n = self.begin[t + 1] - self.begin[t]
        at = np.repeat(self.begin[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rare = np.bincount(np.repeat(text * size, n) + self.item[at], np.repeat(q, n) * self.value[at], minlength=len(bags) * size).reshape(len(bags), size)
        # upper bounds of the blocks; those below the k-th best that is certain by now are ruled out
        bound = matrix @ self.common_most + self._most(rare)
        need = bound * (1 + 1e-4) >= -np.partition(-rare, most - 1, axis=1)[:, most - 1 : most]
        cos = np.full((len(bags), size), -1.0)
        for b in np.flatnonzero(need.any(axis=0)).tolist():
            rows, cut = np.flatnonzero(need[:, b]), slice(b * EXAMPLE_BLOCK, min(size, (b + 1) * EXAMPLE_BLOCK))
            cos[rows, cut] = rare[rows, cut] + matrix[rows] @ self.common[:, cut]
        # rounded, so that examples with the same words tie whatever the order of the sums
        cos = np.round(cos / np.where(norm > 0, norm, 1.0)[:, None], 6)
        last = -np.partition(-cos, most - 1, axis=1)[:, most - 1]
        out = []
        for c, least in zip(cos, last):
            places = np.flatnonzero((c >= least) & (c > 0))
            places = places[np.lexsort((places, -c[places]))[:most]]
            out.append((c[places], places))
        return out

    def score(self, cos: np.ndarray, places: np.ndarray) -> tuple[float, list[int]]:
        """The vote of the nearest, and the first three of them."""
        weight = cos.astype(float) ** 2 * self.votes[places]
        score = (float(weight @ self.labels[places]) + PRIOR * self.base) / (float(weight.sum()) + PRIOR)
        return min(1.0, max(0.0, score)), self.ids[places[:3]].tolist()


def _scored(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = index.value
        for batch in batches:
            if near is None:
                none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0), pa.array(np.zeros(batch.num_rows)), none], ["id", "score", "evidence"])
                continue
            scores, evidence = [], []
            for bags in _bags(batch.column(1)):
                for i in range(0, len(bags), BLOCK):
                    for cos, places in near.nearest_of(bags[i : i + BLOCK]):
                        s, e = near.score(cos, places)
                        scores.append(s)
                        evidence.append(e)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["id", "score", "evidence"])

    return run


def build_index(rows: DataFrame, known: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> NearestExamples | None:
    """rows: id, text. known: id, label. An index of at most `examples` labelled texts and all their words, whatever the input;
    None without labelled texts of both classes."""
    spark = rows.sparkSession
    labelled = written(known.where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label")), "labels")
    # texts with a label: the sieve keeps most others from the shuffle, the join the rest
    sieve = spark.sparkContext.broadcast(Sieve(labelled.select("id")))
    with small_batches(spark):
        some = rows.mapInArrow(_passing(sieve), "id long, text string")
        texts = some.join(labelled.hint("shuffle_hash"), "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    texts = written(texts, "labelled")
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, rest = size.get(1, 0), size.get(0, 0)
    if not pos or not rest:
        return None
    parts = [texts.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(examples // 2) for c in (1, 0)]
    chosen = written(parts[0].unionByName(parts[1]), "examples")
    people = chosen.select("id", "label").toPandas().sort_values("id")  # at most `examples` rows
    ids, labels = people["id"].to_numpy(), people["label"].to_numpy()
    got = chosen.select("id", "text").mapInArrow(_example_words, "id long, word long, n long").toArrow()
    vocabulary, place = np.unique(got["word"].to_numpy().astype(np.uint64), return_inverse=True)
    shared = spark.sparkContext.broadcast(vocabulary)
    counts = rows.select("text").mapInArrow(_frequencies(shared), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    n = np.ones(len(vocabulary) + 1, np.int64)
    n[counts["word"].to_numpy()] = counts["n"].to_numpy()  # the last one, -1: all texts
    idf = np.log1p(n[-1] / np.maximum(1, n[:-1]))
    counts = texts.select("label", "text").mapInArrow(_class_counts(shared), "word int, a long, n long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).toArrow()
    both = np.zeros((2, len(vocabulary) + 1), np.int64)
    both[:, counts["word"].to_numpy()] = counts["a"].to_numpy(), counts["n"].to_numpy()
    tells = telling(both[0, :-1], both[1, :-1], pos, rest)
    at = (place, np.searchsorted(ids, got["id"].to_numpy()), got["n"].to_numpy())
    taken = np.bincount(at[1], minlength=len(ids)) > 0
    held = [max(1, int((taken & (labels == c)).sum())) for c in (0, 1)]
    return NearestExamples(vocabulary, idf, ids, labels, at, pos / (pos + rest), k, tells, 0.0, ((rest / held[0]) / (pos / held[1]), 1.0))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, threshold: float = 0.7, examples: int = EXAMPLES) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1), predicted (score >= threshold), evidence.

    evidence: ids of up to three nearest examples. Labels are (id_col, label_col); those of
    the held-out fold are not learnt from.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    known = labels.select(column(id_col).cast("long").alias("id"), column(label_col).alias("label")).where("id IS NOT NULL").where(~held_out(F.col("id"), folds, fold))
    index = docs.sparkSession.sparkContext.broadcast(build_index(rows, known, examples))
    scored = rows.mapInArrow(_scored(index), "id long, score double, evidence array<long>")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
