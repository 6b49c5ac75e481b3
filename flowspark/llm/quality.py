"""Quality of texts by a regularised quadratic discriminant.

Each text gives transformed statistics (shares of kinds of characters, lengths, repetition
of words, shingles and lines). Labelled texts give the mean and the covariance of either
class, as sums over partitions; the covariances are shrunk towards their diagonal and towards
the pooled one. The score is the logistic function of the difference of the Mahalanobis
log-densities, each from a Cholesky factor that is computed once.

Null texts are empty texts and get a score like any other. Null labels, and labels of unknown
texts, are not used; where a class has no labelled text all scores are 0.5. Repeated rows are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import shingle_hashes, slices, text_buffers, word_hashes

SHRINK, POOL, SOFT = 0.1, 0.1, 30
NAMES = ("letters", "upper", "doubled", "marks", "stops", "breaks", "word_length", "size", "types", "top_word", "shingles", "marked_words", "wide")


def _counter(table: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text the number of its bytes that the table marks."""
    total = np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _table(test) -> np.ndarray:
    return np.asarray([bool(test(chr(b))) if b < 128 else False for b in range(256)])


_LETTER = _table(str.isalpha) | (np.arange(256) >= 0xC0)
_UPPER, _DIGIT = _table(str.isupper), _table(str.isdigit)
_STOP = _table(lambda c: c in ".,;:'\"-()")
_MARK = _table(lambda c: c.isprintable() and not c.isalnum() and c != " " and c not in ".,;:'\"-()")
_BREAK, _WIDE = _table(lambda c: c == "\n"), np.arange(256) >= 0xC0


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of transformed statistics, a few MB of text at a time; NAMES has their order."""
    for a, b in slices(column):
        buf, off = text_buffers(column.slice(a, b - a))
        words, start, stop, at = word_hashes(buf, off)
        n = np.diff(off).astype(float)
        k = np.diff(at).astype(float)
        counts = {x: _counter(t, buf, off) for x, t in (("letters", _LETTER), ("upper", _UPPER), ("digits", _DIGIT), ("marks", _MARK), ("stops", _STOP), ("breaks", _BREAK), ("wide", _WIDE))}
        marked = np.zeros(len(words), bool)
        if len(words):
            marked = _MARK[buf[stop - 1]] | _MARK[buf[start]]
        marked = np.concatenate(([0], np.cumsum(marked)))
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        doubled = np.concatenate(([0], np.cumsum(again)))
        types, top, runs = np.zeros(b - a), np.zeros(b - a), np.zeros(b - a)
        for i in range(b - a):
            w = words[at[i] : at[i + 1]]
            if not len(w):
                continue
            s = np.sort(w)
            cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            types[i], top[i] = len(cut) - 1, np.diff(cut).max()
            sh = np.sort(shingle_hashes(w))
            runs[i] = (1 + np.count_nonzero(sh[1:] != sh[:-1])) / len(sh)
        # shares of short texts are drawn towards those of plain prose
        root = lambda x: np.sqrt(np.maximum(x, 0))
        share = lambda x, of, usual: (x + SOFT * usual) / (of + SOFT)
        yield np.column_stack([
            share(counts["letters"], n - counts["digits"], 0.78), root(share(counts["upper"], counts["letters"], 0.03)), root(share(doubled[at[1:]] - doubled[at[:-1]], k, 0)), root(share(counts["marks"], n, 0)), root(share(counts["stops"], n, 0.02)),
            root(share(counts["breaks"], n, 0.005)), np.log(share(counts["letters"], k, 5)), np.log1p(k), np.log(share(types, SOFT + k**0.85, 1)), root(share(top, k, 0.05)), share(runs * k, k, 1), root(share(marked[at[1:]] - marked[at[:-1]], k, 0)), root(share(counts["wide"], n, 0.02)),
        ])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for x in statistics(batch.column(1)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0).slice(done, len(x)), lists], ["id", "x"])
            done += len(x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each label: how many, and the sums of x and of the products of x."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        x, y = _matrix(batch.column(1)), batch.column(0).to_numpy()
        for label in np.unique(y).tolist():
            z = np.column_stack([np.ones((y == label).sum()), x[y == label]])
            sums[label] = sums.get(label, 0) + z.T @ z
    for label, s in sums.items():
        yield pa.record_batch([pa.array([label] * s.size, pa.int32()), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], ["label", "k", "v"])


class Discriminant:
    """Means, Cholesky factors and log-determinants of the two classes, and the log of their ratio."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float = SHRINK, pool: float = POOL) -> None:
        self.known = all(sums.get(c) is not None and sums[c][0, 0] >= 2 for c in (0, 1))
        if not self.known:
            return
        n = {c: s[0, 0] for c, s in sums.items()}
        self.mean = {c: s[0, 1:] / n[c] for c, s in sums.items()}
        own = {c: s[1:, 1:] / n[c] - np.outer(self.mean[c], self.mean[c]) for c, s in sums.items()}
        both = (own[0] * n[0] + own[1] * n[1]) / (n[0] + n[1])
        self.factor, self.log_det = {}, {}
        for c in (0, 1):
            cov = (1 - pool) * own[c] + pool * both
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
            self.factor[c] = np.linalg.cholesky(cov)
            self.log_det[c] = 2 * np.log(np.diag(self.factor[c])).sum()
        self.inverse = {c: np.linalg.inv(f) for c, f in self.factor.items()}
        self.prior = float(np.log(n[1] / n[0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        log = {c: -0.5 * ((((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) + self.log_det[c]) for c in (0, 1)}
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -60, 60)))


def fit(rows: DataFrame, label_col: str = "label", x_col: str = "x", shrink: float = SHRINK, pool: float = POOL) -> Discriminant:
    """From rows with a label of 0 or 1 and their statistics; all of them count, as sums."""
    kept = rows.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), F.col(x_col).alias("x"))
    got = kept.mapInArrow(_moments, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    width = len(NAMES) + 1
    sums = {c: np.zeros(width * width) for c in {r["label"] for r in got}}
    for r in got:
        sums[r["label"]][r["k"]] = r["v"]
    return Discriminant({c: s.reshape(width, width) for c, s in sums.items()}, shrink, pool)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.record_batch([batch.column(0), pa.array(model.value.scores(_matrix(batch.column(1))))], ["id", "score"])

    return run


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _known(labels: DataFrame, id_col: str, label_col: str, folds: int, fold: int) -> DataFrame:
    return labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id"), folds, fold))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows and columns of docs whose text scores the threshold at least; texts are not shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = written(rows.mapInArrow(_statistics, "id long, x array<double>"), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats.join(_known(labels, id_col, label_col, folds, fold).hint("merge"), "id")))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *map(model.value.scores, statistics(texts))]))

    return docs.where(score(F.col(f"`{text_col}`").cast("string")) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1), predicted (score >= threshold).

    Labels are (id_col, label_col); those of the held-out fold are not learnt from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = written(rows.mapInArrow(_statistics, "id long, x array<double>"), "statistics")
    known = _known(labels, id_col, label_col, folds, fold)
    model = docs.sparkSession.sparkContext.broadcast(fit(stats.join(known.hint("merge"), "id")))
    scored = stats.mapInArrow(_scored(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
