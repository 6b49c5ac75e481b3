"""Training with weights averaged in the cluster, trajectories, folds, and the resumable chain, against NumPy."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import chain, folds, fusion, training
from flowspark.operators.scoring import Dense
from flowspark.plans import models
from flowspark.spec import FUSION_MODES


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(0).normal(size=(900, 6))
    return spark.createDataFrame([(i, v.tolist(), [float(v[0] > 0)], str(i % 3)) for i, v in enumerate(x)], "id long, x array<double>, y array<double>, cls string")


def numpy_epochs(dealt, job, epochs, lr, batch, make=None):
    """The same averaging in one process: every shard improves a copy of the weights, rows weigh."""
    layers = job.layers
    shards = {}
    for r in dealt.collect():
        shards.setdefault(r["shard"], []).append(r)
    for e in range(epochs):
        total, n = 0, 0
        for s, got in sorted(shards.items()):
            got = [r for r in got if job.without is None or r["cls"] != job.without]
            x, y = np.asarray([r["x"] for r in got], np.float32), np.asarray([r["y"] for r in got], np.float32)
            model = training._Adam(layers, training.bce_loss, lr, 0, 0.0, 0.0)
            rng = np.random.default_rng([job.seed, e, s, 0])
            if make:
                x, y = make(x, y, rng)
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                model.step(x[order[i : i + batch]], y[order[i : i + batch]])
            total, n = total + training.flat(model.layers) * model.rows, n + model.rows
        layers = training.shaped(total / n, layers)
    return layers


def same(a, b, tol=1e-5):
    return all(np.allclose(p, q, atol=tol) for m, n in zip(a, b, strict=True) for p, q in zip(m, n, strict=True))


def test_weights_are_averaged_in_the_cluster(spark, rows, monkeypatch):
    monkeypatch.setattr(training, "PIECE", 16)  # several pieces a model
    dealt = training.deal(rows, "id", 5)
    assert dealt.rdd.getNumPartitions() <= 5 and dealt.select("shard").distinct().count() == 5
    jobs = {"all": training.Job(Dense.random([6, 8, 1], 0).layers, 1), "without 2": training.Job(Dense.random([6, 8, 1], 4).layers, 2, "2")}
    both = training.train_jobs(dealt, jobs, training.bce_loss, 2, lr=1e-2, batch=64)
    for name, job in jobs.items():
        # a job does not depend on those that are trained beside it
        assert same(both[name][0], training.train_jobs(dealt, {name: job}, training.bce_loss, 2, lr=1e-2, batch=64)[name][0], 0)
        assert same(both[name][0], numpy_epochs(dealt, job, 2, 1e-2, 64))
    make = training.block_fakes(2, 0.5, 1.0, 3.0)
    got = training.train_jobs(dealt, {"f": jobs["all"]}, training.bce_loss, 3, lr=1e-2, batch=64, make=make)["f"]
    assert same(got[0], numpy_epochs(dealt, jobs["all"], 3, 1e-2, 64, make)) and len(got[1]) == 3


def test_driver_gets_one_set_of_weights(spark, rows, monkeypatch):
    """Rows that reach the driver in an epoch, for 1 and for 40 shards."""
    seen = []
    real = training._add_up
    counts = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in real(batches):
            counts.add(b.num_rows)
            yield b

    monkeypatch.setattr(training, "_add_up", counted)
    for shards in (1, 40):
        counts.value = 0
        training.train_jobs(training.deal(rows, "id", shards), {"it": training.Job(Dense.random([6, 8, 1], 0).layers)}, training.bce_loss, 1)
        seen.append(counts.value)
    assert seen == [1, 1]


def test_fakes_and_mined_rows():
    x = np.random.default_rng(1).normal(size=(500, 5)).astype(np.float32)
    make = training.block_fakes(2, 0.4, 2.0, 3.0)
    (a, y), (b, _) = make(x, None, np.random.default_rng([7, 0])), make(x, None, np.random.default_rng([7, 1]))
    assert y[:, 0].tolist() == [0.0] * 500 + [1.0] * 500 and (a[:500] == x).all() and not np.allclose(a[500:], b[500:])  # anew each epoch
    fake, r = a[500:], x[:, 2:]
    assert (fake[:, :2] == x[:, :2]).all()
    ratio = fake[:, 2:] / r
    radial = np.ptp(ratio, axis=1) < 1e-4
    assert 0.3 < radial.mean() < 0.5 and ratio[radial].min() >= 2 and ratio[radial].max() <= 3
    others = {tuple(v): i for i, v in enumerate(r)}
    assert all(tuple(v) in others and others[tuple(v)] != i for i, v in enumerate(fake[:, 2:]) if not radial[i])
    one, _ = make(x[:1], None, np.random.default_rng(0))
    assert np.ptp(one[1, 2:] / x[0, 2:]) < 1e-5  # alone: nobody to swap with
    model = Dense([(np.asarray([[1.0], [0], [0], [0], [0]], np.float32), np.zeros(1, np.float32))])
    p = {"mu0": 0.0, "sd0": 1.0, "mu1": 0.0, "sd1": 1.0, "tau_z": -1.0, "theta_z": 0.5, "theta_union": None, "tau_hi_z": None}
    s = np.full((500, 1), 1.0)
    got, truth = chain.mined_fakes(2, (0.4, 2.0, 3.0), [model], p, 4)(x, s, np.random.default_rng(0))
    hit = x[:, 0] > 0.5
    assert len(got) == 1000 + 4 * hit.sum() and truth.sum() == 500 and (got[1000:] == np.repeat(x[hit], 4, axis=0)).all()
    assert (fusion.alarms_of_scores(s[:, 0], x[:, 0], p | {"theta_union": 0.2}) == (x[:, 0] > 0.2)).all()


def test_all_epochs_in_one_scan(spark, rows):
    sets = {e: Dense.random([6, 8, 4, 1], e).layers for e in range(3)}
    path = training.Trajectory(spark, models.scratch(spark, "path"))
    for e, w in sets.items():
        path.add(e, Dense.random([6, 8, 4, 1], 9).layers, 1.0)
        path.add(e, w, 0.5)  # written again
    assert all(same(path.read()[e], w, 0) for e, w in sets.items())
    got = {(r["epoch"], r["y"]): r for r in training.bce_sums(rows.select("x", F.col("y")[0].alias("y")), sets).collect()}
    x = np.asarray([r["x"] for r in rows.orderBy("id").collect()])
    y = x[:, 0] > 0
    for e, w in sets.items():
        p = 1 / (1 + np.exp(-Dense(w).forward(x)[:, 0]))
        assert math.isclose(got[e, 1]["total"], -np.log(p[y]).sum(), rel_tol=1e-4) and got[e, 1]["n"] == y.sum()
        assert math.isclose(got[e, 0]["total"], -np.log(1 - p[~y]).sum(), rel_tol=1e-4)


def test_stop_rule_of_a_growing_curve(spark):
    rng = np.random.default_rng(2)
    for k in range(20):
        curve = (np.cumsum(rng.normal(-0.05, 0.3, 15)) + 5).tolist()
        want = spark.range(1).select(folds.entropy_stop(F.array(*map(F.lit, curve)), 3, 0.02)).first()[0] if k < 4 else None
        best, done = training.entropy_stop_at(curve, 3, 0.02)
        ends = next((i for i in range(1, 16) if training.entropy_stop_at(curve[:i], 3, 0.02)[1]), None)
        assert done == (ends is not None) and (ends is None or training.entropy_stop_at(curve[:ends], 3, 0.02)[0] == best)
        assert want is None or want == best


@pytest.fixture(scope="module")
def benign(spark, data):
    return models.vectors(spark, data).where("label = 0").select("id", "x")


def recipe(n):
    return replace(models.small_recipe(), pools=(n // 5, n // 9), epochs=2, cap=2, rounds=1)


def test_a_chain_is_taken_up_where_it_broke_off(spark, benign, tmp_path, monkeypatch):
    r = recipe(benign.count())
    whole = chain.retrain(spark, benign, f"file://{tmp_path}/whole", r)

    def broken(*a, **b):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(chain, "fit_pseudo_classifier", broken)
        with pytest.raises(RuntimeError, match="lost"):
            chain.retrain(spark, benign, f"file://{tmp_path}/again", r)
    assert (tmp_path / "again/monitor.done").exists() and not (tmp_path / "again/second_stage.done").exists()
    with monkeypatch.context() as m:
        m.setattr(chain, "fit_autoencoder", broken)  # steps that are done are not run again
        again = chain.retrain(spark, benign, f"file://{tmp_path}/again", r)
    assert same(whole.clf.layers, again.clf.layers, 1e-4) and same(whole.ae.encoder.layers, again.ae.encoder.layers, 1e-4)
    for mode in ("A", "B"):
        for k in ("tau_z", "theta_z"):
            assert math.isclose(whole.decision[mode][k], again.decision[mode][k], rel_tol=1e-2, abs_tol=1e-3)

    # thresholds and moments by NumPy from the model's own weights
    steps = chain.Steps(spark, f"file://{tmp_path}/whole")
    pool = {p: np.asarray([v["x"] for v in steps.read("pools").where(F.col("pool") == p).orderBy("id").collect()], np.float32) for p in ("gradient", "select", "monitor")}
    n = benign.count()
    assert [len(pool[p]) for p in ("select", "monitor", "gradient")] == [n // 5, n // 9, n - n // 5 - n // 9]
    z, y = whole.ae.forward(pool["select"])
    assert np.allclose(whole.whitening.mean, (y - pool["select"]).mean(0), atol=1e-5) and np.allclose(whole.z_mean, z.mean(0), atol=1e-5)

    def scores(p):
        z, y = whole.ae.forward(pool[p])
        w = np.concatenate([(z - whole.z_mean) / whole.z_std, whole.whitening.apply((y - pool[p]).astype(float))], axis=1)
        return ((y - pool[p])[:, models.LINEAR :] ** 2).mean(1), whole.clf.forward(w.astype(np.float32))[:, 0]

    (s, logit), (sel, sel_logit) = scores("gradient"), scores("select")
    u = np.log10(np.maximum(s, 1e-12))
    for mode, (tau, alpha, _, high) in FUSION_MODES.items():
        d = whole.decision[mode]
        assert np.allclose(d["mu"], [u.mean(), logit.mean()], atol=1e-4) and np.allclose(d["sd"], [u.std(), logit.std()], atol=1e-4)
        z0 = (np.log10(sel) - d["mu"][0]) / d["sd"][0]
        z1 = (sel_logit - d["mu"][1]) / d["sd"][1]
        assert math.isclose(d["tau_z"], (np.log10(np.percentile(sel, tau)) - d["mu"][0]) / d["sd"][0], abs_tol=1e-3)
        over = z1[z0 > d["tau_z"]]
        if alpha * len(sel) < len(over):
            assert math.isclose(d["theta_z"], np.quantile(over, 1 - alpha * len(sel) / len(over)), abs_tol=1e-3)
    assert set(whole.report["false_alarms"]) == {"A", "B"} and whole.report["hardening"]["rounds"] == 1


def test_size_gates_and_seeds(spark, benign, tmp_path, monkeypatch):
    r = recipe(benign.count())
    with pytest.raises(ValueError, match="too few"):
        chain.retrain(spark, benign, f"file://{tmp_path}/few", replace(r, least_rows=10**6))
    with pytest.warns(UserWarning, match="less certain"):
        chain.check_size(benign.count(), replace(r, least_rows=10**6, warn_rows=10**7, force=True))
    rates = {1: (0.2, 0.1), 2: (0.1, 0.3), 3: (0.1, 0.2), 4: None}

    def fake(spark, rows, folder, recipe, **kw):
        if rates[recipe.seed] is None:
            raise ValueError("no minimum after the untrained weights")
        return chain.Retrained(None, None, None, None, None, {}, {"false_alarms": dict(zip("AB", rates[recipe.seed], strict=True))})

    monkeypatch.setattr(chain, "retrain", fake)
    assert chain.retrain_seeds(spark, benign, "x", r, [1, 2, 3, 4])[0] == 3
    with pytest.raises(ValueError, match="no seed"):
        chain.retrain_seeds(spark, benign, "x", r, [4])


def test_training_goes_through_the_layers_as_scoring_does():
    rng = np.random.default_rng(3)
    layers = [(w.astype(np.float64), b.astype(np.float64) + 0.1) for w, b in Dense.random([5, 7, 4, 2], 1).layers]
    x, y = rng.normal(size=(20, 5)), rng.normal(size=(20, 2))
    out, grads = training._back(layers, x, lambda o: 2 * (o - y))
    assert np.allclose(out, Dense(layers).forward(x))
    loss = lambda: ((Dense(layers).forward(x) - y) ** 2).sum()
    for (w, b), (gw, gb) in zip(layers, grads, strict=True):
        for a, g in ((w, gw), (b, gb)):
            at = tuple(rng.integers(0, n) for n in a.shape)
            a[at] += 1e-6
            up = loss()
            a[at] -= 2e-6
            assert math.isclose((up - loss()) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-4)
            a[at] += 1e-6


def test_every_shard_has_a_task_of_its_own(spark):
    rows = spark.range(2000).select("id", F.array(F.col("id").cast("float")).alias("x"), F.array(F.lit(0.0)).alias("y"))
    files = training.deal(rows, "id", 12).groupBy(F.input_file_name().alias("file")).agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("n")).collect()
    assert [r["shards"] for r in files] == [1] * 12 and sum(r["n"] for r in files) == 2000
