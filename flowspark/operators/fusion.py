"""The decision rule on the plane (log10 of the first score, logit of the second).

Scores have columns s, logit, label and pool (train, select, test). Parameters are one-row tables;
a branch that is off has a NULL threshold.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log10_floor
from ..spec import FUSION_MODES
from .profile import column_quantiles

INF = float("inf")


def standardiser(df: DataFrame, s: str = "s_dae", logit: str = "logit") -> DataFrame:
    """One row mu0, sd0, mu1, sd1 over the rows given (benign training rows); a std below 1e-12 counts as 1."""
    u0, u1 = log10_floor(F.col(s)), F.col(logit).cast("double")
    sd = lambda x: F.when(F.stddev_pop(x) < 1e-12, 1.0).otherwise(F.stddev_pop(x))
    return df.agg(F.avg(u0).alias("mu0"), sd(u0).alias("sd0"), F.avg(u1).alias("mu1"), sd(u1).alias("sd1"))


def to_plane(df: DataFrame, st: DataFrame, s: str = "s_dae", logit: str = "logit") -> DataFrame:
    """df with z0 and z1."""
    got = df.crossJoin(F.broadcast(st.select("mu0", "sd0", "mu1", "sd1")))  # one row
    z0, z1 = (log10_floor(F.col(s)) - F.col("mu0")) / F.col("sd0"), (F.col(logit) - F.col("mu1")) / F.col("sd1")
    return got.withColumns({"z0": z0, "z1": z1}).drop("mu0", "sd0", "mu1", "sd1")


def tau_to_plane(tau: Column, mu0: Column | str = "mu0", sd0: Column | str = "sd0") -> Column:
    mu0, sd0 = (F.col(c) if isinstance(c, str) else c for c in (mu0, sd0))
    return (F.log10(tau) - mu0) / sd0


def and_thetas(z: DataFrame, tau_z: float, alphas: list[float]) -> list[tuple[float, bool]]:
    """(theta_z, capped) for each alpha: the logit threshold at which the AND rule flags that share of z.

    z: benign selection rows (z0, z1). No row above tau_z: +inf. A budget that covers all of them:
    -inf. Counts come to the driver, all quantiles from one table of distinct values.
    """
    over = z.where(F.col("z0") > tau_z)
    c = z.agg(F.count("*").alias("n"), F.count_if(F.col("z0") > tau_z).alias("g")).first()
    if c["g"] == 0:
        return [(INF, True)] * len(alphas)
    within = [a for a in alphas if a * c["n"] < c["g"]]
    got = iter(column_quantiles(over, "z1", [1 - a * c["n"] / c["g"] for a in within]).first()["q"] if within else [])
    return [(next(got), False) if a * c["n"] < c["g"] else (-INF, True) for a in alphas]


def and_theta(z: DataFrame, tau_z: float, alpha: float) -> tuple[float, bool]:
    """and_thetas for one alpha."""
    return and_thetas(z, tau_z, [alpha])[0]


def union_thetas(z: DataFrame, tau_z: float, theta_z: float, targets: list[float]) -> list[float]:
    """The logit threshold over rows that the AND rule leaves, for each total share in `targets`; a budget already used: +inf."""
    hit = (F.col("z0") > tau_z) & (F.col("z1") > theta_z)
    c = z.agg(F.count("*").alias("n"), F.count_if(hit).alias("h")).first()
    free = c["n"] - c["h"]
    left = [t * c["n"] - c["h"] for t in targets]
    open_ = [x for x in left if x > 0 and free]
    got = iter(column_quantiles(z.where(~hit), "z1", [1 - x / free for x in open_]).first()["q"] if open_ else [])
    return [next(got) if x > 0 and free else INF for x in left]


def union_theta(z: DataFrame, tau_z: float, theta_z: float, target: float) -> float:
    """union_thetas for one share."""
    return union_thetas(z, tau_z, theta_z, [target])[0]


def fuse_predict(z0: Column, z1: Column, p: dict[str, Column]) -> Column:
    """AND, or the logit branch, or the high first score; thresholds of branches that are off are NULL."""
    off = lambda c: F.coalesce(p[c], F.lit(INF))
    return ((z0 > p["tau_z"]) & (z1 > p["theta_z"])) | (z1 > off("theta_union")) | (z0 > off("tau_hi_z"))


def fired_branch(z0: Column, z1: Column, p: dict[str, Column]) -> Column:
    """Which branch raised the alarm, the most certain first; '' for none."""
    off = lambda c: F.coalesce(p[c], F.lit(INF))
    return F.when((z0 > p["tau_z"]) & (z1 > p["theta_z"]), "consensus").when(z1 > off("theta_union"), "logit").when(z0 > off("tau_hi_z"), "first stage").otherwise("")


def alarms_of_scores(s: np.ndarray, logit: np.ndarray, p: dict[str, float]) -> np.ndarray:
    """fuse_predict on arrays, for rows that are in a task already."""
    off = lambda c: INF if p[c] is None else p[c]
    z0, z1 = (np.log10(np.maximum(s.astype(float), 1e-12)) - p["mu0"]) / p["sd0"], (logit.astype(float) - p["mu1"]) / p["sd1"]
    return ((z0 > p["tau_z"]) & (z1 > p["theta_z"])) | (z1 > off("theta_union")) | (z0 > off("tau_hi_z"))


PARAMETERS = ["mu0", "sd0", "mu1", "sd1", "tau_z", "theta_z", "theta_union", "tau_hi_z"]


def calibrate(train: DataFrame, select: DataFrame, tau_pct: float, alpha: float, target: float | None, hi_pct: float | None, s: str = "s_dae", logit: str = "logit") -> DataFrame:
    """One row of PARAMETERS from benign training and selection rows, computed now: each step needs the
    numbers of the one before, and later plans hold literals."""
    return calibrate_modes(train, select, {"": (tau_pct, alpha, target, hi_pct)}, s, logit).drop("mode")


def calibrate_modes(train: DataFrame, select: DataFrame, modes: dict[str, tuple[float, float, float | None, float | None]], s: str = "s_dae", logit: str = "logit") -> DataFrame:
    """(mode, PARAMETERS) for each recipe (tau_pct, alpha, target, hi_pct): moments and thresholds of the first score come from one
    scan each for all recipes, and recipes with the same tau share the table of their logits."""
    st = standardiser(train, s, logit).first()
    wanted = sorted({p for tau, _, _, hi in modes.values() for p in (tau, hi) if p is not None})
    found = column_quantiles(select, s, [p / 100 for p in wanted]).first()["q"]
    plane = {p: (math.log10(max(t, 1e-12)) - st["mu0"]) / st["sd0"] for p, t in zip(wanted, found)}
    z = select.select(((log10_floor(F.col(s)) - st["mu0"]) / st["sd0"]).alias("z0"), ((F.col(logit) - st["mu1"]) / st["sd1"]).alias("z1"))
    theta: dict[tuple[float, float], float] = {}
    for tau in {tau for tau, _, _, _ in modes.values()}:
        alphas = sorted({a for t, a, _, _ in modes.values() if t == tau})
        theta |= {(tau, a): t for a, (t, _) in zip(alphas, and_thetas(z, plane[tau], alphas))}
    union: dict[tuple[float, float, float | None], float | None] = {}
    for tau, alpha in theta:
        targets = sorted({t for u, a, t, _ in modes.values() if (u, a) == (tau, alpha) and t is not None})
        got = union_thetas(z, plane[tau], theta[tau, alpha], targets) if targets else []
        union |= {(tau, alpha, t): None if x == INF else x for t, x in zip(targets, got)}
    rows = [(m, *map(float, st), plane[tau], theta[tau, a], union.get((tau, a, t)), plane.get(hi)) for m, (tau, a, t, hi) in modes.items()]
    return train.sparkSession.createDataFrame(rows, "mode string, " + ", ".join(f"{c} double" for c in PARAMETERS))


def fusion_modes(scores: DataFrame, s: str = "s_dae", logit: str = "logit") -> DataFrame:
    """(mode, PARAMETERS): the recipes A and B on benign training and selection rows."""
    ben = scores.where("label = 0 AND pool IN ('train', 'select')").select("pool", s, logit).persist()  # read by every step of the calibration
    out = calibrate_modes(ben.where("pool = 'train'"), ben.where("pool = 'select'"), FUSION_MODES, s, logit)
    ben.unpersist()
    return out


def apply_modes(scores: DataFrame, params: DataFrame, s: str = "s_dae", logit: str = "logit") -> DataFrame:
    """Every row under every mode: columns mode, z0, z1, alarm, branch. params: a row a mode."""
    got = scores.crossJoin(F.broadcast(params))
    z0, z1 = (log10_floor(F.col(s)) - F.col("mu0")) / F.col("sd0"), (F.col(logit) - F.col("mu1")) / F.col("sd1")
    got = got.withColumns({"z0": z0, "z1": z1})
    p = {c: F.col(c) for c in PARAMETERS}
    return got.withColumns({"alarm": fuse_predict(F.col("z0"), F.col("z1"), p), "branch": fired_branch(F.col("z0"), F.col("z1"), p)}).drop(*PARAMETERS)
