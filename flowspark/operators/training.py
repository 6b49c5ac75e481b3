"""Training by data-parallel averaging: every epoch is one job in which each task improves the
shared weights of all models in training on its own rows (Adam), and the weights are averaged by rows.

Rows are written once, a file a shard, in the order of a hash of their keys; an epoch reads them
where they lie, without a shuffle. A shard's rows pass through its task a block at a time, each
block in an order of the epoch's own. Weights are averaged in the cluster: cut into pieces of
PIECE numbers, each piece of all shards meets in one task that adds them up in order, and the driver
gets one set of weights a model, however many shards there are.

Many models (folds, seeds) share an epoch's job: a task reads a block once and improves all of them.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scoring import Autoencoder, Dense, matrix, sigmoid, vector

Weights = list[tuple[np.ndarray, np.ndarray]]
#: A shard is one task's work in an epoch; its rows are streamed a block at a time, never held.
SHARD_ROWS, BLOCK_ROWS = 500_000, 8192
#: Weights in one row of the reduction.
PIECE = 4096


def _back(layers: Weights, x: np.ndarray, grad_out: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, Weights]:
    """Output and gradients of a stack of layers, rectified but for the last."""
    acts = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        x = np.maximum(x, 0) if i + 1 < len(layers) else x
        acts.append(x)
    g = grad_out(acts[-1])
    grads: Weights = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append((acts[i].T @ g, g.sum(axis=0)))
        if i:
            g = (g @ layers[i][0].T) * (acts[i] > 0)
    return acts[-1], grads[::-1]


class _Adam:
    """The weights of one shard, improved batch by batch."""

    def __init__(self, layers: Weights, loss, lr: float, seed: int, noise: float, l2: float) -> None:
        self.layers = [(w.astype(np.float64), b.astype(np.float64)) for w, b in layers]
        self.m, self.v = ([[np.zeros_like(a) for a in p] for p in self.layers] for _ in range(2))
        self.loss, self.lr, self.noise, self.l2 = loss, lr, noise, l2
        self.rng = np.random.default_rng(seed)
        self.total, self.rows, self.t = 0.0, 0, 0

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        self.t += 1
        x, y = x.astype(np.float64), y.astype(np.float64)
        if self.noise:
            x = x + self.noise * self.rng.standard_normal(x.shape)
        value = 0.0

        def grad(out: np.ndarray) -> np.ndarray:
            nonlocal value
            value, g = self.loss(out, y)
            return g

        _, grads = _back(self.layers, x, grad)
        self.total, self.rows = self.total + value * len(x), self.rows + len(x)
        for i, pair in enumerate(grads):
            new = []
            for j, g in enumerate(pair):
                g = g + (self.l2 * self.layers[i][j] if j == 0 else 0)
                self.m[i][j] = 0.9 * self.m[i][j] + 0.1 * g
                self.v[i][j] = 0.999 * self.v[i][j] + 0.001 * g * g
                new.append(self.layers[i][j] - self.lr * (self.m[i][j] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i][j] / (1 - 0.999**self.t)) + 1e-8))
            self.layers[i] = (new[0], new[1])

    def weights(self) -> Weights:
        return [(w.astype(np.float32), b.astype(np.float32)) for w, b in self.layers]


def bce_loss(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    p = np.clip(sigmoid(out), 1e-7, 1 - 1e-7)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), (p - y) / y.size


def mixed_loss(n_linear: int):
    """Mean squared error over the first places plus cross-entropy over the others."""

    def loss(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        d = out[:, :n_linear] - y[:, :n_linear]
        value, grad = (d**2).mean() if d.size else 0.0, 2 * d / max(d.size, 1)
        b, g = bce_loss(out[:, n_linear:], y[:, n_linear:]) if out.shape[1] > n_linear else (0.0, np.zeros((len(out), 0)))
        return float(value + b), np.concatenate([grad, g], axis=1)

    return loss


@dataclass
class Job:
    """A model in training: its weights, the seed of its orders, noise and fakes, and a class whose rows it does not see."""

    layers: Weights
    seed: int = 0
    without: str | None = None


def flat(layers: Weights) -> np.ndarray:
    return np.concatenate([a.ravel().astype(np.float64) for pair in layers for a in pair])


def shaped(weights: np.ndarray, like: Weights) -> Weights:
    """The inverse of flat, in single precision. Weights too small for its normal range (those of dead units decay to there) are 0: they change no
    sum, but processors take many times as long over them."""
    weights = np.where(np.abs(weights) < np.finfo(np.float32).tiny, 0.0, weights)
    out, at = [], 0
    for pair in like:
        new = []
        for a in pair:
            new.append(weights[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        out.append((new[0], new[1]))
    return out


def deal(df: DataFrame, key: str, shards: int | None = None) -> DataFrame:
    """df (x, y, and cls if models leave classes out) written in the order of training: shard by shard, by a hash of the key.

    x and y are arrays or packed rows, as df has them; without y a row is to give itself."""
    shards = shards or max(1, -(-df.count() // SHARD_ROWS))
    cls = F.col("cls").cast("string") if "cls" in df.columns else F.lit(None).cast("string")
    y = vector(df, "y") if "y" in df.columns else F.lit(None).cast("binary")
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), vector(df, "x").alias("x"), y.alias("y"), cls.alias("cls"), F.xxhash64(key).alias("h"), F.col(key).alias("key"))
    return written(rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "key").select("shard", "x", "y", "cls"), "shards")  # by its number: hashed numbers meet in one task


@contextmanager
def a_task_a_file(spark: SparkSession):
    """Files are neither put together nor cut as they are read: what a shard learns does not depend on their sizes and the number of cores."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(1 << 30))
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def _improve(jobs: list[Job], epoch: int, loss, lr: float, batch: int, noise: float, l2: float, make):
    """One epoch of all jobs over the rows of a task: pieces of weights times rows, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, models, held, n, block = None, [], [], 0, 0

        def learn() -> None:
            nonlocal held, n, block
            x, y, cls = (np.concatenate(p) for p in zip(*held, strict=True))
            for job, model in zip(jobs, models, strict=True):
                rng = np.random.default_rng([job.seed, epoch, shard, block])
                own = slice(None) if job.without is None else cls != job.without
                a, b = make(x[own], y[own], rng) if make else (x[own], y[own])
                order = rng.permutation(len(a))
                for i in range(0, len(a), batch):
                    model.step(a[order[i : i + batch]], b[order[i : i + batch]])
            held, n, block = [], 0, block + 1

        def result() -> Iterator[pa.RecordBatch]:
            if n:
                learn()
            for j, model in enumerate(models):
                w = flat(model.layers) * model.rows
                cut = [w[i : i + PIECE].tobytes() for i in range(0, len(w), PIECE)]
                k = len(cut)
                yield pa.record_batch([pa.array([j] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([shard] * k, pa.int32()), pa.array([model.rows] * k, pa.int64()), pa.array([model.total] * k), pa.array(cut, pa.binary())], ["job", "piece", "shard", "n", "loss", "w"])

        for b in batches:
            shards, x, cls = b.column(0).to_numpy(), matrix(b.column(1)), np.asarray(b.column(3).to_pylist(), object)
            y = x if b.column(2).null_count == len(b) else matrix(b.column(2))
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for i, k in zip(edges[:-1], edges[1:], strict=True):
                if i == k:
                    continue
                if shards[i] != shard:
                    if models:
                        yield from result()
                    shard, held, n, block = int(shards[i]), [], 0, 0
                    models = [_Adam(job.layers, loss, lr, hash((job.seed, epoch, shard)) % 2**32, noise, l2) for job in jobs]
                while i < k:
                    take = min(k - i, BLOCK_ROWS - n)
                    held.append((x[i : i + take], y[i : i + take], cls[i : i + take]))
                    n, i = n + take, i + take
                    if n == BLOCK_ROWS:
                        learn()
        if models:
            yield from result()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (job, piece, shard): one row a piece, added up in that order."""
    last, n, loss, total = None, 0, 0.0, None

    def give() -> pa.RecordBatch:
        return pa.record_batch([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["job", "piece", "n", "loss", "w"])

    for b in batches:
        for job, piece, _, rows, value, w in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (job, piece) != last:
                if last is not None:
                    yield give()
                last, n, loss, total = (job, piece), 0, 0.0, np.zeros(len(w) // 8)
            n, loss, total = n + rows, loss + value, total + np.frombuffer(w, np.float64)
    if last is not None:
        yield give()


def train_jobs(
    rows: DataFrame, jobs: dict[str, Job], loss, epochs: int, lr: float = 1e-3, batch: int = 256, noise: float = 0.0, l2: float = 0.0,
    make: Callable[[np.ndarray, np.ndarray, np.random.Generator], tuple[np.ndarray, np.ndarray]] | None = None,
    on_epoch: Callable[[int, dict[str, tuple[Weights, float]]], set[str] | None] | None = None,
) -> dict[str, tuple[Weights, list[float]]]:
    """Weights and mean loss per epoch of every job. rows: as deal wrote them.

    make turns a block (x, y) into what is learnt from it in this epoch, with a generator that depends on the
    job's seed, epoch, shard and block only. on_epoch gets all weights and losses and may name jobs that stop.
    """
    now = {k: (j.layers, []) for k, j in jobs.items()}
    open_ = list(jobs)
    for epoch in range(epochs):
        if not open_:
            break
        some = [Job(now[k][0], jobs[k].seed, jobs[k].without) for k in open_]
        pieces = rows.mapInArrow(_improve(some, epoch, loss, lr, batch, noise, l2, make), "job int, piece int, shard int, n long, loss double, w binary")
        parts = min(sum(-(-len(flat(j.layers)) // PIECE) for j in some), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        met = pieces.repartition(parts, "job", "piece").sortWithinPartitions("job", "piece", "shard", "n")
        got: dict[int, list] = {}
        with a_task_a_file(rows.sparkSession):
            sums = met.mapInArrow(_add_up, "job int, piece int, n long, loss double, w binary").collect()  # one set of weights a job
        for r in sorted(sums, key=lambda r: (r["job"], r["piece"])):
            got.setdefault(r["job"], []).append(r)
        for i, k in enumerate(open_):
            if i not in got or not got[i][0]["n"]:
                raise ValueError("no rows to learn from")
            n = got[i][0]["n"]
            weights = np.concatenate([np.frombuffer(r["w"], np.float64) for r in got[i]]) / n
            now[k] = (shaped(weights, now[k][0]), [*now[k][1], got[i][0]["loss"] / n])
        if on_epoch and (stop := on_epoch(epoch, {k: (now[k][0], now[k][1][-1]) for k in open_})):
            open_ = [k for k in open_ if k not in stop]
    return now


def train(df: DataFrame, layers: Weights, loss, key: str, epochs: int, shards: int | None = None, seed: int = 0, on_epoch: Callable[[int, Weights, float], bool] | None = None, dealt: DataFrame | None = None, **how) -> tuple[Weights, list[float]]:
    """Weights and mean loss per epoch of one model. df: columns x and y as deal takes them, or dealt: what it gave. on_epoch(epoch, weights,
    loss) may stop the training by returning True."""
    watch = (lambda e, got: {"it"} if on_epoch(e, *got["it"]) else None) if on_epoch else None
    return train_jobs(deal(df, key, shards) if dealt is None else dealt, {"it": Job(layers, seed)}, loss, epochs, on_epoch=watch, **how)["it"]


def packed(layers: Weights) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, *[a for pair in layers for a in pair])
    return buf.getvalue()


def unpacked(raw: bytes) -> Weights:
    got = np.load(io.BytesIO(raw))
    arrays = [got[f"arr_{i}"] for i in range(len(got.files))]
    return list(zip(arrays[::2], arrays[1::2], strict=True))


class Trajectory:
    """A table of a training's weights by epoch; an epoch that is written again replaces the former one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def add(self, epoch: int, layers: Weights, loss: float) -> None:
        row = self.spark.createDataFrame([(bytearray(packed(layers)), float(loss))], "weights binary, loss double")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def read(self) -> dict[int, Weights]:
        """Weights by epoch, in order: as many sets as there were epochs."""
        rows = self.spark.read.parquet(self.folder).select("epoch", "weights").collect()
        return {r["epoch"]: unpacked(bytes(r["weights"])) for r in sorted(rows, key=lambda r: r["epoch"])}


def _stacked(sets: list[Weights]):
    """Logits (models x rows) of models of the same widths: one matrix product for the first layer of all."""
    first = np.concatenate([s[0][0] for s in sets], axis=1)
    deeper = [(np.stack([s[i][0] for s in sets]), np.stack([s[i][1] for s in sets])[:, None]) for i in range(1, len(sets[0]))]
    bias, width = np.stack([s[0][1] for s in sets])[:, None], sets[0][0][0].shape[1]

    def forward(x: np.ndarray) -> np.ndarray:
        h = (x @ first).reshape(len(x), len(sets), width).swapaxes(0, 1) + bias
        for w, b in deeper:
            h = np.matmul(np.maximum(h, 0), w) + b
        return h[:, :, 0]

    return forward


def bce_sums(df: DataFrame, sets: dict[int, Weights], x_col: str = "x", y_col: str = "y") -> DataFrame:
    """(epoch, y, total, n): cross-entropy of rows under all epochs' weights from one scan, summed by truth (0 or 1)."""
    epochs, forward = list(sets), _stacked(list(sets.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, len(epochs))), np.zeros(2, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                y = part.column(1).to_numpy(zero_copy_only=False) > 0.5
                p = np.clip(sigmoid(forward(matrix(part.column(0))).astype(np.float64)), 1e-7, 1 - 1e-7)
                total[1] -= np.log(p[:, y]).sum(1)
                total[0] -= np.log(1 - p[:, ~y]).sum(1)
                n += [int((~y).sum()), int(y.sum())]
        k = [i for i in (0, 1) if n[i]]
        yield pa.record_batch([pa.array(epochs * len(k), pa.int32()), pa.array(np.repeat(k, len(epochs)), pa.int32()), pa.array(total[k].ravel()), pa.array(np.repeat(n[k], len(epochs)))], ["epoch", "y", "total", "n"])

    got = df.select(vector(df, x_col).alias("x"), F.col(y_col).cast("float").alias("y")).mapInArrow(run, "epoch int, y int, total double, n long")
    return got.groupBy("epoch", "y").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def monitor_curve(benign: DataFrame, pseudo: DataFrame) -> DataFrame:
    """(epoch, bce) from sums of both kinds (bce_sums): benign ones are computed once and serve for any pseudo-anomalies."""
    return benign.unionByName(pseudo).groupBy("epoch").agg((F.sum("total") / F.sum("n")).alias("bce"))


def entropy_stop_at(curve: list[float], patience: int, drop: float) -> tuple[int, bool]:
    """(place of the last accepted minimum, whether patience is used up): the rule of folds.entropy_stop while a curve grows."""
    low, best, moved, bad = curve[0], 0, 0.0, 0
    for i in range(1, len(curve)):
        moved += abs(curve[i] - curve[i - 1])
        if curve[i] < low and low - curve[i] > drop * moved:
            low, best, moved, bad = curve[i], i, 0.0, 0
        else:
            bad += 1
            if bad >= patience:
                return best, True
    return best, False


def mirrored(widths: list[int], seed: int) -> tuple[Weights, int]:
    """Random layers of an encoder and its mirror as one stack, and how many of them encode."""
    enc, dec = Dense.random(widths, seed), Dense.random(widths[::-1], seed + 1)
    return [*enc.layers, *dec.layers], len(enc.layers)


def autoencoder_of(layers: Weights, k: int, n_linear: int) -> Autoencoder:
    return Autoencoder(Dense(layers[:k]), Dense(layers[k:]), n_linear)


def fit_autoencoder(
    df: DataFrame, key: str, x_col: str, widths: list[int], n_linear: int, epochs: int = 5, noise: float = 0.05, seed: int = 0,
    measure: Callable[[Autoencoder], float] | None = None, patience: int = 0, drop: float = 0.0, untrained: bool = False, **how,
) -> tuple[Autoencoder, list[float]]:
    """A denoising autoencoder on benign rows. widths: input to latent; the decoder mirrors them.

    measure: a value of the model after each epoch (an entropy of losses, or minus an average precision);
    training ends by the rule of entropy_stop_at, whose epoch's weights count. An end at the untrained weights is an
    error unless `untrained` ones will do. The values then are the second result, those of the untrained model first.
    """
    # one stack: the latent is rectified like any inner layer
    layers, k = mirrored(widths, seed)
    rows = df.select(key, F.col(x_col).alias("x"))
    if measure is None:
        layers, history = train(rows, layers, mixed_loss(n_linear), key, epochs, seed=seed, noise=noise, **how)
        return autoencoder_of(layers, k, n_linear), history
    kept, curve = [layers], [measure(autoencoder_of(layers, k, n_linear))]

    def on_epoch(epoch: int, weights: Weights, loss: float) -> bool:
        kept.append(weights)
        curve.append(measure(autoencoder_of(weights, k, n_linear)))
        return entropy_stop_at(curve, patience, drop)[1]

    train(rows, layers, mixed_loss(n_linear), key, epochs, seed=seed, noise=noise, on_epoch=on_epoch, **how)
    best = entropy_stop_at(curve, patience, drop)[0]
    if not best and not untrained:
        raise ValueError(f"no minimum after the untrained weights: {curve}")
    return autoencoder_of(kept[best], k, n_linear), curve


def block_fakes(latent: int, delta: float, low: float, high: float):
    """What an epoch learns from a block of benign rows [z, r]: them (0), and a pseudo-anomaly of each (1), made anew each time:
    with chance delta the residual times a factor in [low, high), else that of another row of the block."""

    def make(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        radial = (rng.random(n) < delta) | (n < 2)
        a = rng.uniform(low, high, n)
        other = (np.arange(n) + rng.integers(1, max(n, 2), n)) % max(n, 1)
        r = x[:, latent:]
        fake = np.concatenate([x[:, :latent], np.where(radial[:, None], a[:, None] * r, r[other])], axis=1).astype(np.float32)
        return np.concatenate([x, fake]), np.repeat([0.0, 1.0], n)[:, None]

    return make


def on_features(make, features: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """make on what `features` gives for the rows of a block: a vector and a score each, worked out anew in each epoch and kept nowhere."""

    def run(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        v, s = features(x)
        return make(v, s[:, None], rng)

    return run


def fit_pseudo_classifier(
    rows: DataFrame, widths: list[int], make, monitor: DataFrame | None = None, epochs: int = 100, patience: int = 15, least: float = 1e-6, seed: int = 0,
    trajectory: Trajectory | None = None, start: Dense | None = None, **how,
) -> tuple[Dense, list[float]]:
    """A classifier of benign rows against pseudo-anomalies that `make` makes from each block in each epoch. rows: dealt (x).

    monitor: rows (x, y) whose cross-entropy is taken after each epoch; the weights of its minimum count, and
    `patience` epochs without a better one end the training. Second result: that curve, or the losses. Weights
    of every epoch go to the trajectory."""
    layers = start.layers if start else Dense.random([*widths, 1], seed).layers
    best: dict = {"bce": float("inf"), "at": None, "layers": None}
    curve: list[float] = []

    def on_epoch(epoch: int, got: dict[str, tuple[Weights, float]]) -> set[str] | None:
        weights, loss = got["it"]
        if trajectory:
            trajectory.add(epoch, weights, loss)
        if monitor is None:
            return None
        curve.append(bce_sums(monitor, {0: weights}).agg(F.sum("total") / F.sum("n")).first()[0])
        if curve[-1] < best["bce"] - least:
            best.update(bce=curve[-1], at=epoch, layers=weights)
        return {"it"} if epoch - (best["at"] if best["at"] is not None else -1) >= patience else None

    layers, history = train_jobs(rows, {"it": Job(layers, seed)}, bce_loss, epochs, make=make, on_epoch=on_epoch, **how)["it"]
    if monitor is None:
        return Dense(layers), history
    if best["layers"] is None:
        raise ValueError("no epoch with a finite loss")
    return Dense(best["layers"]), curve


def train_folds(
    df: DataFrame, key: str, x_col: str, label: str, cls: str, folds: list[tuple[str, int]], widths: list[int], epochs: int = 5, shards: int | None = None, **how
) -> dict[tuple[str, int], Dense]:
    """A classifier of benign rows against real attacks for each fold (class left out, seed): one Spark job an epoch for all."""
    rows = df.select(key, F.col(x_col).alias("x"), F.array(F.col(label).cast("float")).alias("y"), F.col(cls).cast("string").alias("cls"))
    jobs = {f"{c}/{s}": Job(Dense.random([*widths, 1], s).layers, s, str(c)) for c, s in folds}
    got = train_jobs(deal(rows, key, shards), jobs, bce_loss, epochs, **how)
    return {(c, s): Dense(got[f"{c}/{s}"][0]) for c, s in folds}


def logits_of_all(df: DataFrame, models: list[Dense], x_col: str, keep: list[str]) -> DataFrame:
    """df's columns `keep` and logits: an array with a value for each model, from one scan."""
    forward = _stacked([m.layers for m in models])
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = forward(matrix(b.column(0))).T.astype(np.float64) if b.num_rows else np.zeros((0, len(models)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(models)), pa.int32()), pa.array(v.ravel()))
            yield pa.record_batch([*b.columns[1:], lists], [*keep, "logits"])

    return df.select(vector(df, x_col).alias("x"), *keep).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "logits array<double>"]))


def fit_classifier(benign: DataFrame, fakes: DataFrame, key: str, x_col: str, widths: list[int], epochs: int = 5, seed: int = 0, **how) -> tuple[Dense, list[float]]:
    """A classifier of benign rows (0) against others (1): pseudo-anomalies, or real attacks as an upper bound."""
    make = lambda d, v: d.select(F.col(key).alias("key"), F.col(x_col).alias("x"), F.array(F.lit(float(v))).alias("y"))
    rows = make(benign, 0).unionByName(make(fakes, 1))
    layers, history = train(rows, Dense.random([*widths, 1], seed).layers, bce_loss, "key", epochs, **how)
    return Dense(layers), history


def mine_hard_negatives(score: Callable[[Dense], DataFrame], refit: Callable[[DataFrame], Dense], model: Dense, tau: float, rounds: int, gain: Callable[[Dense], float], least: float) -> tuple[Dense, list[float]]:
    """Benign rows that the model flags are added to its training rows, until the gain is small.

    score gives (key, logit) of benign training rows, refit a model from the pool of keys so far.
    The best round counts.
    """
    pool = None
    best, values = model, [gain(model)]
    for _ in range(rounds):
        found = score(model).where(F.col("logit") >= tau).select("key")
        pool = found if pool is None else pool.unionByName(found).distinct()
        model = refit(pool)
        values.append(gain(model))
        if values[-1] >= max(values):
            best = model
        if values[-1] - values[-2] < least:
            break
    return best, values


def latent_scaler(df: DataFrame, z_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and std (divisor n, below 1e-8 as 1) by place."""
    got = sorted(df.select(F.posexplode(z_col).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect())
    std = np.asarray([r["s"] for r in got])
    return np.asarray([r["m"] for r in got]), np.where(std < 1e-8, 1.0, std)


def forest_importance(df: DataFrame, cols: list[str], label: str, key: str, trees: int = 100, folds: int = 5, most: int = 200_000) -> DataFrame:
    """(feature, importance) of a random forest over a balanced sample of at most `most` rows, averaged over folds by hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from .sampling import balanced_sample

    rows = balanced_sample(df.select(key, label, *[F.col(c).cast("double").alias(c) for c in cols]).na.fill(0.0), key, label, "rf", most)
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(rows).withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds))).persist()
    total = np.zeros(len(cols))
    for f in range(folds):
        model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=10, seed=f).fit(data.where(F.col("_fold") != f))
        total += model.featureImportances.toArray()
    data.unpersist()
    return df.sparkSession.createDataFrame([(c, float(v / folds)) for c, v in zip(cols, total)], "feature string, importance double")


