"""Queries that SQL does not express, against NumPy and pandas on the smallest tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark import plans
from flowspark.operators import training
from flowspark.plans import models
from flowspark.plans.flow_view import flows

Q = plans.QUERIES
relu = lambda v: np.maximum(v, 0)
sig = lambda v: 1 / (1 + np.exp(-v))


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    raw = np.asarray([r["embedding"] for r in rows], float)
    x = np.concatenate([raw[:, : models.LINEAR], raw[:, models.LINEAR :] > 0], axis=1)
    return np.asarray([r["vec_id"] for r in rows]), np.asarray([r["label"] for r in rows]), raw, x


def forward(x):
    ae, n = models.autoencoder(), models.LINEAR
    (a, b), (c, d) = ae.encoder.layers
    z = relu(relu(x @ a + b) @ c + d)
    (a, b), (c, d) = ae.decoder.layers
    y = relu(z @ a + b) @ c + d
    return z, np.concatenate([y[:, :n], sig(y[:, n:])], axis=1)


def mlp(layers, x):
    for i, (w, b) in enumerate(layers):
        x = x @ w + b if i + 1 == len(layers) else relu(x @ w + b)
    return x[:, 0]


def shrunk(r):
    """Mean, shrunk covariance and shrinkage after Ledoit and Wolf, observation by observation."""
    n, p = r.shape
    c = r - r.mean(axis=0)
    cov = c.T @ c / n
    target = np.trace(cov) / p
    delta = ((cov - target * np.eye(p)) ** 2).sum() / p
    beta = min(sum(((np.outer(v, v) - cov) ** 2).sum() for v in c) / n**2 / p, delta)
    s = beta / delta
    return r.mean(axis=0), (1 - s) * cov + s * target * np.eye(p), s


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_forward_passes(spark, data, vectors):
    ids, _, _, x = vectors
    z, y = forward(x)
    got = by_id(Q["m01_dae_forward"](spark, data), "latent", "width", "mean")
    assert all(got[i][:2] == (models.LATENT, models.WIDTH) and abs(got[i][2] - m) < 2e-4 for i, m in zip(ids, y.mean(axis=1)))
    from flowspark.operators.scoring import Dense

    got = by_id(Q["m09_mlp_forward"](spark, data), "logit")
    assert np.allclose([got[i][0] for i in ids], mlp(Dense.random([models.WIDTH, 16, 1], 4).layers, x), atol=1e-3)


def test_whitening_and_scores(spark, data, vectors):
    ids, label, _, x = vectors
    z, y = forward(x)
    ben = label % 5 != 0
    mean, cov, s = shrunk((y - x)[ben])
    rows = {r["place"]: r for r in Q["m04_fit_whitening"](spark, data).collect()}
    assert np.allclose([rows[i]["mean"] for i in range(64)], mean, atol=1e-4) and np.allclose([rows[i]["sigma"] for i in range(64)], np.sqrt(np.diag(cov)), rtol=1e-3)
    assert abs(rows[0]["shrinkage"] - s) < 1e-3
    assert all(r["same"] for q in ("m05_apply_whitening", "m10_fold_affine") for r in Q[q](spark, data).collect())
    factor = np.linalg.cholesky(np.linalg.inv(cov))
    std = z[ben].std(axis=0)
    phi = lambda z, r: np.concatenate([(z - z_mean) / np.where(std < 1e-8, 1, std), (r - mean) @ factor], axis=1)
    z_mean = z[ben].mean(axis=0)
    logit = mlp(models.classifier().layers, phi(z, y - x))
    score = ((y - x)[:, models.LINEAR :] ** 2).mean(axis=1)
    got = by_id(Q["m11_score_flows"](spark, data), "s_dae", "logit", "s_pa")
    assert np.allclose([got[i][0] for i in ids], score, atol=1e-5)
    assert np.allclose([got[i][1] for i in ids], logit, atol=2e-2, rtol=2e-2) and np.allclose([got[i][2] for i in ids], sig(logit), atol=1e-2)
    # pseudo-anomalies on the plane: as many as benign rows, and the radial ones follow from the hash alone
    placed = by_id(Q["m18_pseudo_placement"](spark, data), "u0", "u1")
    assert set(placed) == set(ids[ben].tolist()) and all(np.isfinite(v).all() for v in placed.values())


def test_monitor_curve(spark, data):
    got = {r["epoch"]: r for r in Q["m17_monitor_bce_curve"](spark, data).collect()}
    bce = [got[e]["bce"] for e in range(4)]
    low, best, bad = bce[0], 0, 0
    for e, v in enumerate(bce[1:], 1):
        if bad < 2:
            low, best, bad = (v, e, 0) if v < low else (low, best, bad + 1)
    assert {r["stop"] for r in got.values()} == {best} and bce[-1] < bce[0]


def test_training_queries_learn(spark, data, vectors):
    ap = [r["ap"] for r in Q["m13_fit_autoencoder"](spark, data).orderBy("epoch").collect()]
    assert len(ap) >= 4 and all(0 < a <= 1 for a in ap)
    bce = [r["bce"] for r in Q["m14_fit_pseudo_classifier"](spark, data).orderBy("epoch").collect()]
    assert bce[-1] < bce[0]
    ap = Q["m15_fit_supervised_mlp"](spark, data).first()["ap"]
    assert (vectors[1] % 5 == 0).mean() * 0.5 < ap <= 1
    flagged = [r["flagged"] for r in Q["m16_hard_negative_mining"](spark, data).orderBy("round").collect()]
    assert len(flagged) >= 2 and all(0 <= f <= 1 for f in flagged)
    folds = Q["m19_leave_one_class_out_fit"](spark, data).collect()
    classes = {int(c) for c in vectors[1] if c % 5 == 0}
    assert {(r["excluded"], r["seed"]) for r in folds} == {(c, s) for c in classes for s in (1, 2)} and all(0 <= r["dr"] <= 1 and r["dr_best"] is not None for r in folds)
    steps = {r["step"]: r["value"] for r in Q["m20_retrain_chain"](spark, data).collect()}
    assert {"seed", "shrinkage", "tau_z A", "theta_z B", "false alarms A"} <= set(steps) and 0 <= steps["shrinkage"] <= 1 and steps["seed"] in (42, 43)


def test_an_epoch_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 6))
    df = spark.createDataFrame([(i, v.tolist(), [float(v[0] > 0)]) for i, v in enumerate(x)], "id long, x array<double>, y array<double>")
    from flowspark.operators.scoring import Dense

    fit = lambda d: training.train(d, Dense.random([6, 8, 1], 0).layers, training.bce_loss, "id", 2, shards=3, lr=1e-2, batch=64)
    (a, loss_a), (b, loss_b) = fit(df), fit(df.repartition(7))
    assert np.allclose(loss_a, loss_b) and all(np.allclose(p, q) for m, n in zip(a, b) for p, q in zip(m, n))


def test_spread_of_vectors(spark, data, vectors):
    _, label, raw, _ = vectors
    e = np.sort(np.linalg.eigvalsh(np.cov(raw.T, bias=True)))[::-1]
    got = Q["d18_participation_ratio"](spark, data).first()
    share = np.cumsum(e) / e.sum()
    assert got["n"] == len(raw) and np.isclose(got["ratio"], e.sum() ** 2 / (e**2).sum(), rtol=1e-6)
    assert [got[f"k{p}"] for p in (90, 95, 99)] == [int(np.searchsorted(share, p / 100) + 1) for p in (90, 95, 99)]
    dist = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    ben, att = raw[label % 5 != 0], raw[label % 5 == 0]
    own = dist(ben, ben)
    np.fill_diagonal(own, np.inf)
    q = np.quantile(own.min(axis=1), [0.5, 0.99])
    far = dist(att, ben).min(axis=1)
    got = Q["d23_coverage_metrics"](spark, data).first()
    assert np.allclose([got["inside"], got["shell"], got["far"]], [(far <= q[0]).mean(), ((far > q[0]) & (far <= q[1])).mean(), (far > q[1]).mean()], atol=1e-6)


def test_audit_report(spark, data):
    from flowspark.plans.audits import _FB

    df = flows(spark, data).select("label", *_FB).toPandas().astype(float)
    got = {(r["analysis"], r["feature"]): r["value"] for r in Q["d13_audit_report"](spark, data).collect()}
    ranks = df.rank()
    for c in _FB:
        assert np.isclose(got.get(("spearman_label", c), np.nan), ranks[c].corr(ranks["label"]), atol=1e-6, equal_nan=True)
        values = np.unique(df[c].dropna())
        cdf = lambda part: np.searchsorted(np.sort(part.dropna()), values, side="right") / part.notna().sum()
        assert np.isclose(got["ks", c], np.abs(cdf(df[c][df.label == 1]) - cdf(df[c][df.label == 0])).max(), atol=1e-6)
        p, mu, v = (df[c] == 0).mean(), df[c][df[c] != 0].mean(), df[c].var()
        assert np.isclose(got["variance_ratio", c], p * (1 - p) * mu * mu / v if v else 0.0, atol=1e-6)
        bins = pd.qcut(df[c], 20, labels=False, duplicates="drop")
        joint = pd.crosstab(bins, df.label).to_numpy() / len(df)
        h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
        hx, hy = h(joint.sum(axis=1)), h(joint.sum(axis=0))
        assert np.isclose(got["nmi_label", c], (hx + hy - h(joint)) / ((hx + hy) / 2), atol=1e-6)


def test_forest_finds_the_feature_that_matters(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    got = {r["feature"]: r["importance"] for r in training.forest_importance(df, ["a", "b"], "label", "id", trees=3, folds=2).collect()}
    assert got["a"] > 0.8 and abs(sum(got.values()) - 1) < 1e-9


def test_ablation_report(spark):
    """Recall at 1 % false alarms of each rule, from the rows themselves; the smallest tables have too few rows."""
    data = "/root/testdata/sf0.01"
    df = flows(spark, data).select("pool", "label", "s_dae", "logit").toPandas()
    got = {r["rule"]: r for r in Q["f12_ablation_report"](spark, data).collect()}
    assert set(got) <= {"first", "logit", "and", "and_or_logit"} and {"first", "logit"} <= set(got)
    ben, test = df[(df.label == 0) & (df.pool == "select")], df[df.pool == "test"]
    n = int((test.label == 1).sum())
    for rule, col in (("first", "s_dae"), ("logit", "logit")):
        points = []
        for t in (0.002, 0.005, 0.01, 0.02, 0.05):
            # thresholds on the plane: monotone in the scores
            v = np.log10(np.maximum(df[col], 1e-12)) if col == "s_dae" else df[col]
            theta = np.quantile(v[ben.index], 1 - t)
            hit = v[test.index] > theta
            points.append((hit[test.label == 0].mean(), hit[test.label == 1].mean()))
        points.sort()
        x, y = zip(*points)
        k = max(i for i in range(len(x)) if x[i] <= 0.01)
        want = y[k] if x[k] == 0.01 or k + 1 == len(x) else y[k] + (y[k + 1] - y[k]) * (0.01 - x[k]) / (x[k + 1] - x[k])
        assert abs(got[rule]["recall"] - want) < 0.02, (rule, got[rule], want)
        p = got[rule]["recall"]
        assert got[rule]["low"] <= p <= got[rule]["high"] and n


def test_encoding_fit(spark, data):
    """Totals of the columns that the training recipe makes, from distinct rows."""
    df = flows(spark, data).drop("flow_id", "start_ms", "s_dae", "logit", "pool", "label", "attack").toPandas().drop_duplicates()
    df = df[~(df.DNS_QUERY_TYPE > 255)]
    got = {r["feature"]: r["total"] for r in Q["p24_flow_encode_fit"](spark, data).collect()}
    top = sorted(df.L7_PROTO.value_counts().items(), key=lambda kv: (-kv[1], kv[0]))[:15]
    for v, n in top:
        assert v != int(v) or got[f"l7_{int(v)}"] >= n
    assert got["proto_tcp"] == (df.PROTOCOL == 6).sum() and got["is_dns_flow"] == (df.DNS_QUERY_TYPE > 0).sum()
    assert got["OUT_BYTES"] == df.OUT_BYTES.sum() and got["port_dns"] == (df.L4_DST_PORT == 53).sum()
    second = df.SRC_TO_DST_SECOND_BYTES.replace(np.inf, 46938.0).fillna(0.0)
    assert got["SRC_TO_DST_SECOND_BYTES"] == second.sum()
    for i, bit in enumerate(("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")):
        n = int(((df.CLIENT_TCP_FLAGS.to_numpy(int) >> i) & 1).sum())
        assert (f"client_{bit}" in got) == (100 <= n <= len(df) - 100) and got.get(f"client_{bit}", n) == n
