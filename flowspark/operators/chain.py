"""The label-free retraining chain: from benign-like rows to a calibrated model, in seven steps.

1 pools, 2 first stage with an entropy stop, 3 moments of the second stage's features,
4 pseudo-anomalies of the monitor, 5 second stage with pseudo-anomalies made anew each epoch and an
early stop on the monitor's loss, 6 hardening by mined false alarms, 7 calibration.

Every step writes its tables and then a mark with its small results below one folder. A step whose
mark is there is not run again, so a chain that was broken off is taken up where it ended; a
step without a mark starts anew and replaces what it left. Rows never pass through the driver.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FUSION_MODES, RETRAIN_ENTROPY, RETRAIN_FAKES, RETRAIN_L2, RETRAIN_NOISE, RETRAIN_RATES, RETRAIN_WATCHED
from .fusion import PARAMETERS, alarms_of_scores, apply_modes, calibrate, fusion_modes
from .profile import loss_entropy
from .sampling import pool_sizes, three_pools
from .scoring import Autoencoder, Dense, Phi, Whitening, dae_residuals, fit_whitening, is_packed, lists, matrix, packed_rows, phi_logits, phi_rows, vector
from .training import Trajectory, autoencoder_of, block_fakes, deal, fit_autoencoder, fit_pseudo_classifier, latent_scaler, on_features, packed, unpacked


@dataclass
class Recipe:
    """Parameters of a chain; the defaults are those of the published models."""

    widths: list[int]  # input to latent
    n_linear: int
    hidden: list[int]  # second stage, between its input and the logit
    seed: int = 42
    epochs: int = 60
    entropy: tuple[int, float] = RETRAIN_ENTROPY  # patience, drop
    measure: str = "entropy"  # of the losses of watched rows, or "score": their mean
    eval_rows: int = RETRAIN_WATCHED
    cap: int = 100
    patience: int = 15
    train_fakes: tuple[float, float, float] = RETRAIN_FAKES["train"]  # chance of a radial one, least and largest factor
    monitor_fakes: tuple[float, float, float] = RETRAIN_FAKES["monitor"]
    rounds: int = 5
    copies: int = 4
    least_gain: float = 0.002
    batch: int = 512
    lr: float = RETRAIN_RATES["first"]
    second_lr: float = RETRAIN_RATES["second"]
    noise: float = RETRAIN_NOISE
    l2: float = RETRAIN_L2
    shards: int | None = None
    warn_rows: int = 500_000
    least_rows: int = 100_000
    pools: tuple[int, int] | None = None  # selection and monitor rows; else from the number of rows
    force: bool = False


@dataclass
class Retrained:
    """What a chain ends with; report: stops, losses, rows of pools, mined rows, false alarm rates on the monitor by mode."""

    ae: Autoencoder
    whitening: Whitening
    z_mean: np.ndarray
    z_std: np.ndarray
    clf: Dense
    decision: dict[str, dict]
    report: dict = field(default_factory=dict)


class Steps:
    """Marks of finished steps in a folder: a table of one row each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def result(self, name: str) -> dict | None:
        try:
            rows = self.spark.read.schema("result string").parquet(self.path(f"{name}.done")).collect()
        except AnalysisException:
            return None
        return json.loads(rows[0]["result"]) if rows else None

    def run(self, name: str, make: Callable[[], dict | None]) -> dict:
        if (found := self.result(name)) is not None:
            return found
        got = make() or {}
        self.spark.createDataFrame([(json.dumps(got),)], "result string").coalesce(1).write.mode("overwrite").parquet(self.path(f"{name}.done"))
        return got

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def keep(self, name: str, arrays: list) -> None:
        """Weights or moments: one row."""
        self.spark.createDataFrame([(bytearray(packed(arrays)),)], "raw binary").coalesce(1).write.mode("overwrite").parquet(self.path(name))

    def kept(self, name: str) -> list:
        return unpacked(bytes(self.read(name).first()["raw"]))


def check_size(n: int, recipe: Recipe) -> None:
    """Too few rows are an error unless forced; few rows are a warning."""
    if n < recipe.least_rows and not recipe.force:
        raise ValueError(f"{n} rows are too few to retrain on: {recipe.least_rows} at least")
    if n < recipe.warn_rows:
        warnings.warn(f"{n} rows: thresholds and models are less certain below {recipe.warn_rows}", stacklevel=3)


def mined_fakes(latent: int, fakes: tuple[float, float, float], models: list[Dense], params: dict, copies: int):
    """Like block_fakes; rows that any of the models so far flags by mistake count copies + 1 times. y: the first score."""
    plain = block_fakes(latent, *fakes)

    def make(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        hit = np.zeros(len(x), bool)
        for m in models:
            hit |= alarms_of_scores(y[:, 0], m.forward(x)[:, 0], params)
        both, truth = plain(x, y, rng)
        again = np.repeat(x[hit], copies, axis=0)
        return np.concatenate([both, again]), np.concatenate([truth, np.zeros((len(again), 1))])

    return make


def retrain(spark: SparkSession, rows: DataFrame, folder: str, recipe: Recipe, key: str = "id", x_col: str = "x") -> Retrained:
    """rows: (key, x), taken as benign; key is unique, x an array of floats or a packed row. folder: where steps are written and found again."""
    steps = Steps(spark, folder)
    latent = recipe.widths[-1]
    how = {"batch": recipe.batch, "l2": recipe.l2}

    def pools() -> dict:
        n = rows.count()
        check_size(n, recipe)
        select, monitor = recipe.pools or pool_sizes(n)
        steps.write(three_pools(rows.select(F.col(key).alias("id"), vector(rows, x_col).alias("x")), "id", f"pools {recipe.seed}", select, monitor), "pools")
        return {"n": n, "select": select, "monitor": monitor, "gradient": n - select - monitor}

    sizes = steps.run("pools", pools)
    pooled = steps.read("pools")
    of = lambda df, pool: df.where(F.col("pool") == pool)
    shards: list[DataFrame] = []

    def dealt() -> DataFrame:
        """Gradient rows in the order of training: dealt once, for both stages and the hardening."""
        if not shards:
            shards.append(deal(of(pooled, "gradient").select("id", "x"), "id", recipe.shards))
        return shards[0]

    def first_stage() -> dict:
        gradient = of(pooled, "gradient")
        share = min(1.0, recipe.eval_rows / max(1, sizes["gradient"]))
        # written once: every epoch reads them again
        steps.write(gradient.where(F.pmod(F.xxhash64("id", F.lit("watched")), F.lit(1 << 20)) < math.ceil(share * (1 << 20))), "watched")
        watched = steps.read("watched")

        def watch(ae: Autoencoder) -> float:
            s = F.col("s_dae")
            return dae_residuals(watched, ae, "id").agg(loss_entropy(s) if recipe.measure == "entropy" else F.avg(s)).first()[0]

        ae, curve = fit_autoencoder(gradient, "id", "x", recipe.widths, recipe.n_linear, recipe.epochs, seed=recipe.seed, measure=watch, patience=recipe.entropy[0], drop=recipe.entropy[1], dealt=dealt(), noise=recipe.noise, lr=recipe.lr, **how)
        steps.keep("first_stage", [*ae.encoder.layers, *ae.decoder.layers])
        return {"curve": curve}

    first = steps.run("first_stage", first_stage)
    ae = autoencoder_of(steps.kept("first_stage"), len(recipe.widths) - 1, recipe.n_linear)

    def moments() -> dict:
        steps.write(dae_residuals(of(pooled, "select"), ae, "id").select("z", "r"), "residuals")
        seen = steps.read("residuals")
        wh = fit_whitening(seen, "r")
        mean, std = latent_scaler(seen, "z")
        steps.keep("moments", [(wh.mean, wh.factor), (wh.sigma, np.asarray(wh.shrinkage)), (mean, std)])
        return {"shrinkage": wh.shrinkage}

    shrinkage = steps.run("moments", moments)["shrinkage"]
    (wh_mean, factor), (sigma, _), (z_mean, z_std) = steps.kept("moments")
    wh = Whitening(wh_mean, factor, sigma, shrinkage)
    phi = Phi(ae, wh, z_mean, z_std)

    def monitor() -> None:
        """Benign monitor rows (y 0) and a pseudo-anomaly of each (y 1), made once."""
        mine = deal(phi_rows(of(pooled, "monitor"), phi, "id").select("id", F.col("phi").alias("x"), F.array(F.col("s_dae")).alias("y")), "id", recipe.shards)
        steps.write(fixed_fakes(mine, latent, recipe.monitor_fakes, recipe.seed + 99), "monitor")

    steps.run("monitor", monitor)
    watched = steps.read("monitor")

    start = [latent + recipe.widths[0], *recipe.hidden]

    def second_stage() -> dict:
        clf, curve = fit_pseudo_classifier(dealt(), start, on_features(block_fakes(latent, *recipe.train_fakes), phi.of), watched, recipe.cap, recipe.patience, seed=recipe.seed + 7, trajectory=Trajectory(spark, steps.path("trajectory")), lr=recipe.second_lr, **how)
        steps.keep("second_stage", clf.layers)
        return {"curve": curve}

    second = steps.run("second_stage", second_stage)

    def scores(clf: Dense) -> DataFrame:
        got = phi_logits(pooled, phi, clf, "id", keep=("pool",))
        return got.select("id", F.when(F.col("pool") == "gradient", "train").otherwise(F.col("pool")).alias("pool"), F.lit(0).alias("label"), "s_dae", "logit")

    def hardening() -> dict:
        models = [Dense(steps.kept("second_stage"))]
        mode = FUSION_MODES["A"]
        steps.write(scores(models[0]), "first_scores")  # read by every step of the calibration and by the first round
        s = steps.read("first_scores")
        p = calibrate(s.where("pool = 'train'"), s.where("pool = 'select'"), mode[0], mode[1], mode[2], mode[3]).first().asDict()
        learn, gains, mined = dealt(), [], 0
        for k in range(recipe.rounds):
            flagged = (scores(models[-1]) if k else s).where("pool = 'train'")
            wrong = apply_modes(flagged, spark.createDataFrame([tuple(p.values())], ", ".join(f"{c} double" for c in PARAMETERS))).where("alarm").count()
            gains.append(1 - wrong / max(1, sizes["gradient"]))
            if k and gains[-1] - gains[-2] < recipe.least_gain:
                break
            mined += wrong
            make = on_features(mined_fakes(latent, recipe.train_fakes, list(models), p, recipe.copies), phi.of)
            models.append(fit_pseudo_classifier(learn, start, make, epochs=1, seed=recipe.seed + 23 + k, start=models[-1], lr=recipe.second_lr, **how)[0])
        steps.keep("hardened", models[-1].layers)
        return {"gains": gains, "rounds": len(models) - 1, "flagged": mined}

    hardened = steps.run("hardening", hardening)
    clf = Dense(steps.kept("hardened"))

    def calibration() -> dict:
        steps.write(scores(clf), "scores")
        s = steps.read("scores")
        params = fusion_modes(s)
        modes = {r["mode"]: r.asDict() for r in params.collect()}  # a row a mode
        rates = {r["mode"]: r["rate"] for r in apply_modes(s.where("pool = 'monitor'"), params).groupBy("mode").agg(F.avg(F.col("alarm").cast("double")).alias("rate")).collect()}
        return {"modes": modes, "rates": rates}

    last = steps.run("calibration", calibration)
    decision = {m: {"mu": [p["mu0"], p["mu1"]], "sd": [p["sd0"], p["sd1"]], **{k: p[k] for k in ("tau_z", "theta_z", "theta_union", "tau_hi_z")}} for m, p in last["modes"].items()}
    report = {"seed": recipe.seed, "pools": sizes, "entropy": first["curve"], "monitor_bce": second["curve"], "hardening": hardened, "shrinkage": shrinkage, "false_alarms": last["rates"]}
    return Retrained(ae, wh, z_mean, z_std, clf, decision, report)


def fixed_fakes(rows: DataFrame, latent: int, fakes: tuple[float, float, float], seed: int) -> DataFrame:
    """(x, y): dealt rows and a pseudo-anomaly of each, made once by the same rule as in training."""
    make = block_fakes(latent, *fakes)
    column, kind = (packed_rows, "binary") if is_packed(rows, "x") else (lists, "array<float>")

    def run(batches):
        shard, block = None, 0
        for b in batches:
            shards = b.column(0).to_numpy()
            for k in np.unique(shards):
                shard, block = (k, 0) if k != shard else (shard, block + 1)
                x = matrix(b.column(1))[shards == k]
                both, truth = make(x, None, np.random.default_rng([seed, int(k), block]))
                yield pa.record_batch([column(both), pa.array(truth[:, 0].astype(np.float32))], ["x", "y"])

    return rows.select("shard", "x").mapInArrow(run, f"x {kind}, y float")


def retrain_seeds(spark: SparkSession, rows: DataFrame, folder: str, recipe: Recipe, seeds: list[int], **columns: str) -> tuple[int, Retrained]:
    """The seed with the fewest false alarms on its monitor under mode A (then B, then the smaller seed), and its model.
    A seed without a usable first stage is passed over; none left is an error."""
    got: dict[int, Retrained] = {}
    for s in seeds:
        try:
            got[s] = retrain(spark, rows, f"{folder}/seed={s}", replace(recipe, seed=s), **columns)
        except ValueError as e:
            if "no minimum" not in str(e):
                raise
    if not got:
        raise ValueError("no seed gave a model")
    best = min(got, key=lambda s: (got[s].report["false_alarms"]["A"], got[s].report["false_alarms"]["B"], s))
    return best, got[best]
