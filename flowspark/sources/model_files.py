"""Model folders: weights of both stages, scaler, log features and decision parameters.

A folder holds `dae.npz` (the autoencoder: arrays W_* and b_*), `pa.npz` (the classifier: pa_W0,
pa_b0, ..., pa_W_out, pa_b_out, and the moments of residuals and latents), `scaler_params.json`,
`feature_order.json`, `transform_meta.json` and `soglie.json` (decision parameters by mode). Files
are read by Spark, so that the folder may be in any store that it reads. write_model makes a table
of the same files, one row each. A model's size does not depend on any data.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fusion import PARAMETERS
from ..operators.scoring import Autoencoder, Dense, Whitening
from ..spec import FEATURES, LOG_FEATURES

# --- fixed values: names in the files -----------------------------------------------------
ENCODER, DECODER = ["enc_exp", "enc_mid", "btl"], ["dec_mid", "dec_exp"]
OUTPUTS = ["out_cont", "out_bin"]
WEIGHT_FILES = ["dae.npz", "pa.npz"]
TEXT_FILES = ["soglie.json", "feature_order.json", "scaler_params.json", "transform_meta.json"]
# ------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Everything that scoring needs."""

    ae: Autoencoder
    whitening: Whitening
    z_mean: np.ndarray
    z_std: np.ndarray
    clf: Dense
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    log_features: list[str] = field(default_factory=lambda: list(LOG_FEATURES))
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    decision: dict[str, dict] = field(default_factory=dict)

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(mode, PARAMETERS): a row a mode; branches that are off are NULL."""
        rows = [(m, *p["mu"][:1], *p["sd"][:1], p["mu"][1], p["sd"][1], p["tau_z"], p["theta_z"], p.get("theta_union"), p.get("tau_hi_z")) for m, p in sorted(self.decision.items())]
        return spark.createDataFrame(rows, ", ".join(["mode string", *[f"{c} double" for c in PARAMETERS]]))


def decision_of(params: DataFrame) -> dict[str, dict]:
    """Decision parameters by mode, as the file has them, from a table with a row a mode."""
    return {r["mode"]: {"mu": [r["mu0"], r["mu1"]], "sd": [r["sd0"], r["sd1"]], **{k: r[k] for k in ("tau_z", "theta_z", "theta_union", "tau_hi_z")}} for r in params.collect()}


def _contents(spark: SparkSession, folder: str) -> dict[str, bytes]:
    """The model's files by name: those of a folder, or the rows of a table that write_model made."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*").withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(*WEIGHT_FILES, *TEXT_FILES))
    got = files.select("name", "content").collect()
    got = got or spark.read.schema("name string, content binary").parquet(folder).collect()
    return {r["name"]: bytes(r["content"]) for r in got}


def _layers(w: dict[str, np.ndarray], names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(w[f"W_{n}"], w[f"b_{n}"]) for n in names]


def read_model(spark: SparkSession, folder: str) -> Model:
    """The model in a folder; an error names the files that are missing."""
    files = _contents(spark, folder)
    if missing := [f for f in (*WEIGHT_FILES, *TEXT_FILES) if f not in files]:
        raise FileNotFoundError(f"{folder} lacks {missing}")
    w = {k: v for f in WEIGHT_FILES for k, v in np.load(io.BytesIO(files[f])).items()}
    text = {f: json.loads(files[f]) for f in TEXT_FILES}
    order = text["feature_order.json"]["order"]
    if order != FEATURES:
        raise ValueError(f"{folder} has other features than the contract")
    out = tuple(np.concatenate([w[f"{a}_{n}"] for n in OUTPUTS], axis=-1) for a in ("W", "b"))
    ae = Autoencoder(Dense(_layers(w, ENCODER)), Dense([*_layers(w, DECODER), out]), w["W_out_cont"].shape[-1])
    inner = range(sum(k.startswith("pa_W") for k in w) - 1)
    clf = Dense([(w[f"pa_W{i}"], w[f"pa_b{i}"]) for i in (*inner, "_out")])
    wh = Whitening(w["mu_R"], w["W"], w["sigma_R"], 0.0)
    scaler = {c: (p["mean"], p["std"]) for c, p in text["scaler_params.json"].items()}
    return Model(ae, wh, w["mu_z"], w["sigma_z"], clf, scaler, text["transform_meta.json"]["log_features"], order, text["soglie.json"])


def model_files(model: Model) -> dict[str, bytes]:
    """The contents of the folder's files by name, as read_model reads them."""
    n = model.ae.n_linear
    dae = {f"{a}_{name}": x for name, pair in zip(ENCODER + DECODER, [*model.ae.encoder.layers, *model.ae.decoder.layers[:-1]]) for a, x in zip("Wb", pair)}
    w, b = model.ae.decoder.layers[-1]
    dae |= {"W_out_cont": w[:, :n], "W_out_bin": w[:, n:], "b_out_cont": b[:n], "b_out_bin": b[n:]}
    pa = {"mu_z": model.z_mean, "sigma_z": model.z_std, "mu_R": model.whitening.mean, "W": model.whitening.factor, "sigma_R": model.whitening.sigma}
    names = [*map(str, range(len(model.clf.layers) - 1)), "_out"]
    pa |= {f"pa_{a}{i}": x for i, pair in zip(names, model.clf.layers) for a, x in zip("Wb", pair)} | {"pa_n_layers": np.asarray(len(names) - 1)}

    def packed(arrays: dict[str, np.ndarray]) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, **arrays)
        return buf.getvalue()

    text = {
        "soglie.json": model.decision, "feature_order.json": {"order": model.features}, "transform_meta.json": {"log_features": model.log_features},
        "scaler_params.json": {c: {"mean": m, "std": s, "non_zero_only": False} for c, (m, s) in model.scaler.items()},
    }
    return {"dae.npz": packed(dae), "pa.npz": packed(pa)} | {f: json.dumps(x, indent=2).encode() for f, x in text.items()}


def write_model(spark: SparkSession, model: Model, folder: str) -> None:
    """The model as a table (name, content) of its files: one row a file, written by Spark."""
    rows = [(n, bytearray(c)) for n, c in sorted(model_files(model).items())]
    spark.createDataFrame(rows, "name string, content binary").coalesce(1).write.mode("overwrite").parquet(folder)
