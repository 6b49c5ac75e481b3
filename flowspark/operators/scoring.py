"""Vector scoring: forward passes over Arrow batches with weights that are shipped once.

Weights are small and of fixed size (a layer is at most a few hundred units wide), so they
travel with the function. Anything that is a sum over an array stays in Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash32, uniform


def squared_length(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def mean_square(x: Column, y: Column, start: int = 1, length: int | None = None) -> Column:
    """Mean squared difference of two arrays, over `length` places from `start` (1-based) on."""
    a, b = (x, y) if length is None else (F.slice(x, start, length), F.slice(y, start, length))
    return squared_length(F.zip_with(a, b, lambda p, q: (p - q).cast("double"))) / F.size(a)


def residual(yhat: Column, x: Column) -> Column:
    return F.zip_with(yhat, x, lambda p, q: p - q)


def score_l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.size(v)


def score_l2(v: Column) -> Column:
    return squared_length(F.transform(v, lambda x: x.cast("double"))) / F.size(v)


def build_phi(z: Column, r: Column) -> Column:
    return F.concat(z, r)


def standardise_array(v: Column, mean: list[float], std: list[float]) -> Column:
    """(v - mean) / std by place; a std below 1e-8 counts as 1."""
    m, s = F.array(*map(F.lit, map(float, mean))), F.array(*[F.lit(1.0 if x < 1e-8 else float(x)) for x in std])
    return F.zip_with(F.zip_with(v, m, lambda a, b: a - b), s, lambda a, b: a / b)


@dataclass
class Dense:
    """Layers of (weights, bias), rectified but for the last."""

    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def random(widths: list[int], seed: int) -> Dense:
        rng = np.random.default_rng(seed)
        return Dense([((rng.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float32), np.zeros(b, np.float32)) for a, b in zip(widths, widths[1:])])

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80.0, 80.0)))


@dataclass
class Autoencoder:
    """Encoder to a latent array and decoder with linear places, then places through a sigmoid."""

    encoder: Dense
    decoder: Dense
    n_linear: int

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.maximum(0, self.encoder.forward(x))
        y = self.decoder.forward(z)
        return z, np.concatenate([y[:, : self.n_linear], sigmoid(y[:, self.n_linear :])], axis=1).astype(np.float32)


@dataclass
class Whitening:
    """Benign mean and the factor L of the inverse covariance, which is shrunk (Ledoit and Wolf)."""

    mean: np.ndarray
    factor: np.ndarray
    sigma: np.ndarray
    shrinkage: float

    def apply(self, r: np.ndarray) -> np.ndarray:
        return (r - self.mean) @ self.factor

    def undo(self, w: np.ndarray) -> np.ndarray:
        return w @ np.linalg.inv(self.factor) + self.mean


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays, or of packed rows, as rows of a float matrix."""
    if pa.types.is_binary(column.type):
        if not len(column):
            return np.zeros((0, 0), np.float32)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(column), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 0), np.float32)


def lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


def packed_rows(x: np.ndarray) -> pa.Array:
    """The inverse of matrix for packed rows: the floats of each row as bytes, which Spark moves as one value."""
    x = np.ascontiguousarray(x, np.float32)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def is_packed(df: DataFrame, x_col: str) -> bool:
    return dict(df.dtypes)[x_col] == "binary"


def vector(df: DataFrame, x_col: str) -> Column:
    """A column of vectors as Python tasks take it: packed as it is, else an array of floats."""
    return F.col(x_col) if is_packed(df, x_col) else F.col(x_col).cast("array<float>")


def pack(df: DataFrame, x_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(keep, x_col): arrays of floats of one length, none missing, as packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], packed_rows(matrix(b.column(0)))], names=[*keep, x_col])

    kinds = dict(df.dtypes)
    return df.select(vector(df, x_col).alias("_x"), *keep).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{x_col}` binary"]))


#: Rows that a forward pass takes at once, so that what it makes on the way stays in a core's cache.
SLICE = 2048


def _over(df: DataFrame, id_col: str, x_col: str, make, fields: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, fields) where make gives the Arrow columns for a matrix; keep passes through, so that nothing is joined back."""
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *make(matrix(part.column(0)))], names=[*part.schema.names[1:], *names])

    rows = df.select(vector(df, x_col).alias("_x"), id_col, *keep)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in (id_col, *keep)], fields]))


def dae_forward(df: DataFrame, ae: Autoencoder, id_col: str, x_col: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, z, yhat): latent and reconstruction."""
    return _over(df, id_col, x_col, lambda x: [lists(a) for a in ae.forward(x)], "z array<float>, yhat array<float>", keep)


def dae_residuals(df: DataFrame, ae: Autoencoder, id_col: str, x_col: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, z, r, s_dae): latent, packed residual and the first score, mean squares of the places through the sigmoid."""

    def make(x: np.ndarray) -> list[pa.Array]:
        z, y = ae.forward(x)
        r = y - x
        return [lists(z), packed_rows(r), pa.array((r[:, ae.n_linear :].astype(np.float64) ** 2).mean(axis=1))]

    return _over(df, id_col, x_col, make, "z array<float>, r binary, s_dae double", keep)


def mlp_forward(df: DataFrame, mlp: Dense, id_col: str, x_col: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, logit)."""
    return _over(df, id_col, x_col, lambda x: [pa.array(mlp.forward(x)[:, 0].astype(np.float32))], "logit float", keep)


def score_flows(
    df: DataFrame, ae: Autoencoder, wh: Whitening, z_mean: np.ndarray, z_std: np.ndarray, clf: Dense, id_col: str, x_col: str = "x", keep: tuple[str, ...] = (), explain: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """(id, keep, s_dae, logit, s_pa): both stages in one batch; only three numbers a row leave Python.

    Standardising the latent and whitening the residual are folded into the first layer. explain tells from both scores
    which rows will be alarms: those also get zr, their standardised residuals; others have none.
    """
    folded = fold_affine(clf, z_mean, z_std, wh)
    sigma = np.where(wh.sigma < 1e-8, 1.0, wh.sigma)

    def make(x: np.ndarray) -> list[pa.Array]:
        z, y = ae.forward(x)
        r = y - x
        s = (r[:, ae.n_linear :] ** 2).mean(axis=1)
        logit = folded.forward(np.concatenate([z, r], axis=1))[:, 0]
        out = [pa.array(s.astype(np.float32)), pa.array(logit.astype(np.float32)), pa.array(sigmoid(logit).astype(np.float32))]
        if explain:
            hit = explain(s, logit)
            zr = ((r[hit] - wh.mean) / sigma).astype(np.float32)
            ends = np.concatenate(([0], np.cumsum(hit))) * r.shape[1]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(zr.ravel()), mask=pa.array(~hit)))
        return out

    return _over(df, id_col, x_col, make, "s_dae float, logit float, s_pa float" + (", zr array<float>" if explain else ""), keep)


@dataclass
class Phi:
    """What the second stage learns from: vectors to [scaled latent, whitened residual] and the first score."""

    ae: Autoencoder
    whitening: Whitening
    z_mean: np.ndarray
    z_std: np.ndarray

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._of(x[i : i + SLICE]) for i in range(0, max(1, len(x)), SLICE)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, y = self.ae.forward(x)
        r = y - x
        s = (r[:, self.ae.n_linear :] ** 2).mean(axis=1)
        phi = np.concatenate([(z - self.z_mean) / np.maximum(self.z_std, 1e-8), self.whitening.apply(r.astype(np.float64))], axis=1)
        return phi.astype(np.float32), s.astype(np.float32)


def phi_rows(df: DataFrame, phi: Phi, id_col: str, x_col: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, phi, s_dae): a packed row and the first score."""

    def make(x: np.ndarray) -> list[pa.Array]:
        v, s = phi.of(x)
        return [packed_rows(v), pa.array(s)]

    return _over(df, id_col, x_col, make, "phi binary, s_dae float", keep)


def phi_logits(df: DataFrame, phi: Phi, clf: Dense, id_col: str, x_col: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, s_dae, logit): both scores in one pass; the features of the second stage do not leave the task."""

    def make(x: np.ndarray) -> list[pa.Array]:
        v, s = phi.of(x)
        return [pa.array(s), pa.array(clf.forward(v)[:, 0].astype(np.float32))]

    return _over(df, id_col, x_col, make, "s_dae float, logit float", keep)


def fold_affine(clf: Dense, z_mean: np.ndarray, z_std: np.ndarray, wh: Whitening) -> Dense:
    """The classifier on raw [z, r] that equals clf on [(z - mean) / std, (r - mu) L]."""
    w, b = (a.astype(np.float64) for a in clf.layers[0])
    k = len(z_mean)
    std = np.maximum(z_std, 1e-8)
    first = np.vstack([w[:k] / std[:, None], wh.factor @ w[k:]])
    bias = b - (z_mean / std) @ w[:k] - (wh.mean @ wh.factor) @ w[k:]
    return Dense([(first.astype(np.float32), bias.astype(np.float32)), *clf.layers[1:]])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = matrix(batch.column(0)).astype(np.float64)
        if len(x):
            z = np.column_stack([np.ones(len(x)), x])
            total = (0 if total is None else total) + z.T @ z
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["k", "v"])


def moments(df: DataFrame, x_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with divisor n): partial sums per task, width x width rows to the driver."""
    got = df.select(vector(df, x_col)).mapInArrow(_moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(got))
    for r in got:
        flat[r["k"]] = r["v"]
    m = flat.reshape(int(np.sqrt(len(flat))), -1)
    n = m[0, 0]
    mean = m[0, 1:] / n
    return int(n), mean, m[1:, 1:] / n - np.outer(mean, mean)


def fit_whitening(df: DataFrame, r_col: str) -> Whitening:
    """Two passes over benign residuals: mean and covariance, then the fourth moment that the shrinkage needs."""
    n, mean, cov = moments(df, r_col)

    def fourths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = [(((matrix(b.column(0)) - mean) ** 2).sum(axis=1) ** 2).sum() for b in batches if len(b)]
        yield pa.record_batch([pa.array([float(sum(q))])], ["v"])

    fourth = df.select(vector(df, r_col)).mapInArrow(fourths, "v double").agg(F.sum("v")).first()[0] / n
    p = len(mean)
    target = np.trace(cov) / p
    delta = ((cov - target * np.eye(p)) ** 2).sum() / p
    beta = min((fourth - (cov**2).sum()) / (n * p), delta)
    shrinkage = 0.0 if delta == 0 else beta / delta
    shrunk = (1 - shrinkage) * cov + shrinkage * target * np.eye(p)
    return Whitening(mean, np.linalg.cholesky(np.linalg.inv(shrunk)), np.sqrt(np.diag(shrunk)), float(shrinkage))


def whiten(df: DataFrame, wh: Whitening, id_col: str, r_col: str = "r", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, w)."""
    return _over(df, id_col, r_col, lambda r: [lists(wh.apply(r.astype(np.float64)))], "w array<float>", keep)


def un_whiten(df: DataFrame, wh: Whitening, id_col: str, w_col: str = "w", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, r)."""
    return _over(df, id_col, w_col, lambda w: [lists(wh.undo(w.astype(np.float64)))], "r array<float>", keep)


def radial_fakes(df: DataFrame, key: str, r_col: str, salt: str, delta: float, low: float, high: float, partner: str) -> DataFrame:
    """df with fake_r and radial: with chance delta a * r for a in [low, high), else the partner's residual.

    Chance and factor are hashes of the key, so that a retry makes the same rows.
    """
    radial = uniform(F.col(key), salt + ":d") < delta
    a = F.lit(low) + uniform(F.col(key), salt + ":a") * (high - low)
    fake = F.when(radial, F.transform(r_col, lambda x: x * a)).otherwise(F.col(partner))
    return df.withColumns({"fake_r": fake, "radial": radial})


def residual_zscore(df: DataFrame, alarm: Column, yhat: str, x: str, mean: list[float], sigma: list[float]) -> DataFrame:
    """Rows with an alarm only, with zr: standardised residuals. The filter comes first."""
    return df.where(alarm).withColumn("zr", standardise_array(residual(F.col(yhat), F.col(x)), mean, sigma))


def explained(zr: Column, names: list[str], limit: float) -> Column:
    """(feature, z) beyond the limit by size, or the largest one where none is."""
    pairs = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), zr.alias("z")), lambda p: F.struct(F.abs(p["z"]).alias("size"), p["feature"].alias("feature"), p["z"].alias("z")))
    order = F.reverse(F.array_sort(pairs))
    far = F.filter(order, lambda p: p["size"] > limit)
    return F.transform(F.when(F.size(far) > 0, far).otherwise(F.slice(order, 1, 1)), lambda p: F.struct(p["feature"].alias("feature"), p["z"].alias("z")))


def hashed(key: Column, salt: str, n: int) -> Column:
    return hash32(key, salt) % n
