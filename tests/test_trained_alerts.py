"""The chain from captures to a trained model's alerts: rows are parsed once, pooled where they lie, moved as packed rows, dealt once."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowspark.functions import scalars
from flowspark.operators import chain, sampling, scoring, training
from flowspark.operators.encode import flow_encode
from flowspark.operators.scoring import Dense
from flowspark.plans import models, serving
from flowspark.spec import CONTINUOUS, FEATURES, RAW_COLUMNS


def test_packed_rows_are_the_same_floats():
    x = np.random.default_rng(0).normal(size=(7, 5)).astype(np.float32)
    column = scoring.packed_rows(x)
    assert (scoring.matrix(column) == x).all() and (scoring.matrix(column.slice(2, 3)) == x[2:5]).all()
    assert scoring.matrix(column.slice(0, 0)).shape == (0, 0) and (scoring.matrix(pa.array(column.to_pylist(), pa.binary())) == x).all()


@pytest.mark.parametrize("bits", [32, 17, 1])
def test_pools_by_cuts_are_those_by_places(spark, monkeypatch, bits):
    """Also where many rows share a hash."""
    real = scalars.hash32
    few = lambda key, salt: real(key, salt).bitwiseAND((1 << bits) - 1)
    monkeypatch.setattr(sampling, "hash32", few)
    df = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    place = {r["k"]: r["place"] for r in sampling.places(df, "k", "s").collect()}
    for select, monitor in [(300, 200), (1, 1), (0, 10), (5, 0), (0, 0), (1000, 0), (400, 600), (2000, 5), (999, 1)]:
        got = sampling.three_pools(df, "k", "s", select, monitor)
        want = {k: "select" if p <= select else "monitor" if p <= select + monitor else "gradient" for k, p in place.items()}
        assert {r["k"]: r["pool"] for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan  # rows stay where they lie
    assert sampling.three_pools(df.limit(0), "k", "s", 3, 2).count() == 0
    text = df.select(F.concat(F.lit("é'"), F.col("k").cast("string")).alias("k"))
    at = {r["k"]: r["place"] for r in sampling.places(text, "k", "s").collect()}
    assert all((r["pool"] == "select") == (at[r["k"]] <= 77) for r in sampling.three_pools(text, "k", "s", 77, 20).collect())


def test_rows_are_dealt_and_scored_once_and_packed_ones_train_the_same_model(spark, data, tmp_path, monkeypatch):
    benign = models.vectors(spark, data).where("label = 0").select("id", "x")
    n = benign.count()
    recipe = replace(models.small_recipe(), pools=(n // 5, n // 9), epochs=2, cap=2, rounds=1)
    arrays = chain.retrain(spark, benign, f"file://{tmp_path}/arrays", recipe)
    dealt, scored = [], spark.sparkContext.accumulator(0)
    real_deal, real_forward = chain.deal, chain.phi_logits

    def deal(df, key, shards=None):
        dealt.append(df.count())
        return real_deal(df, key, shards)

    def forward(df, phi, clf, id_col, keep=()):
        got = real_forward(df, phi, clf, id_col, keep=keep)

        def count(batches):
            for b in batches:
                scored.add(b.num_rows)
                yield b

        return got.mapInArrow(count, got.schema)

    monkeypatch.setattr(chain, "deal", deal)
    monkeypatch.setattr(chain, "phi_logits", forward)
    packed = chain.retrain(spark, scoring.pack(benign, "x", ("id",)), f"file://{tmp_path}/packed", recipe)
    sizes = packed.report["pools"]
    assert dealt == [sizes["gradient"], sizes["monitor"]] and scored.value == 2 * n  # before hardening and after it
    for a, b in ((arrays.ae.encoder.layers, packed.ae.encoder.layers), (arrays.clf.layers, packed.clf.layers)):
        assert all(np.allclose(p, q, atol=1e-4) for u, v in zip(a, b, strict=True) for p, q in zip(u, v, strict=True))
    steps = chain.Steps(spark, f"file://{tmp_path}/packed")
    assert dict(steps.read("pools").dtypes)["x"] == dict(steps.read("monitor").dtypes)["x"] == "binary"
    assert not (tmp_path / "packed/phi").exists()  # features of the second stage are worked out where they are used


def test_a_row_without_y_is_to_give_itself(spark):
    x = np.random.default_rng(1).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<float>")
    layers, _ = training.mirrored([4, 3], 0)
    job = {"it": training.Job(layers)}
    one, two = (training.train_jobs(training.deal(d, "id", 2), job, training.mixed_loss(2), 2, lr=1e-2, batch=32)["it"] for d in (df, df.withColumn("y", F.col("x"))))
    assert one[1] == two[1] and all((p == q).all() for u, v in zip(one[0], two[0], strict=True) for p, q in zip(u, v, strict=True))


def test_captures_are_parsed_once(spark, data):
    base = serving.untrained_model()
    raw = serving._raw(spark, data).select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    rows = raw.unionByName(raw).withColumn("id", F.xxhash64(*RAW_COLUMNS))
    x = flow_encode(rows, base.scaler, base.log_features, keep=("id",))
    got = serving.distinct_vectors(x)
    files = got.inputFiles()
    assert files and all("/vectors-" in f for f in files)  # whoever counts or splits the rows reads these
    want = {r["id"]: r["x"] for r in x.groupBy("id").agg(F.min("x").alias("x")).collect()}
    have = {r["id"]: np.frombuffer(r["x"], np.float32) for r in got.collect()}
    assert have.keys() == want.keys() and all((have[k] == np.asarray(want[k], np.float32)).all() for k in want)


def test_whole_numbers_and_bounds_of_the_encoder(spark):
    """Odd fields give what the plain expressions give."""
    odd = ["6", "17.9", "", "x", "NaN", "Infinity", "-Infinity", "1e300", "-5", "255", "9223372036854775808", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id int, t string")
    rows = df.select("id", *[F.col("t").alias(c) for c in RAW_COLUMNS])
    base = serving.untrained_model()
    got = {r["id"]: r["x"] for r in flow_encode(rows, base.scaler, base.log_features, keep=("id",)).collect()}
    at = FEATURES.index
    for r in df.select("id", scalars.lenient_long(F.col("t")).alias("n"), scalars.lenient_double(F.col("t")).alias("d")).collect():
        x = got[r["id"]]
        assert (x[at("proto_tcp")], x[at("proto_udp")]) == (r["n"] == 6, r["n"] == 17) and x[at("port_high")] == (r["n"] >= 1024 and r["n"] not in (3389, 8443, 8080, 8000, 8888))
        finite = 0.0 if not np.isfinite(r["d"]) else r["d"]
        for c in CONTINUOUS[:3]:
            mean, std = base.scaler[c]
            v = np.float64(np.float32(np.log1p(max(finite, 0.0)))) if c in base.log_features else finite
            assert np.isclose(x[at(c)], np.clip((v - mean) / std, -10, 10), atol=1e-5)


def test_features_of_the_second_stage_do_not_depend_on_slices(monkeypatch):
    model = serving.untrained_model()
    phi = scoring.Phi(model.ae, model.whitening, model.z_mean, model.z_std)
    x = np.random.default_rng(2).normal(size=(500, len(FEATURES))).astype(np.float32)
    v, s = phi.of(x)
    z, y = model.ae.forward(x)
    assert np.allclose(v, np.concatenate([z, y - x], axis=1), atol=1e-4) and np.allclose(s, ((y - x)[:, len(CONTINUOUS) :] ** 2).mean(1), rtol=1e-4)
    monkeypatch.setattr(scoring, "SLICE", 64)
    w, t = phi.of(x)
    assert v.dtype == w.dtype == np.float32 and np.allclose(v, w, atol=1e-4) and np.allclose(s, t, rtol=1e-4) and phi.of(x[:0])[0].shape == (0, v.shape[1])
    make = training.on_features(lambda a, b, rng: (a, b), phi.of)
    a, b = make(x, None, None)
    assert (a == w).all() and (b[:, 0] == t).all()


def test_no_weight_is_below_the_normal_range(spark):
    """An input that is always 0 leaves its weights to their decay."""
    tiny = np.finfo(np.float32).tiny
    like = Dense.random([3, 2], 0).layers
    (w, b), *_ = training.shaped(np.asarray([1e-40, -1e-45, tiny, 1.0, -2.0, np.nan, 0.0, -1e-39]), like)
    assert w.ravel().tolist()[:5] == [0.0, 0.0, tiny, 1.0, -2.0] and np.isnan(w[2, 1]) and b.tolist() == [0.0, 0.0]
    rows = spark.range(64).select("id", F.array(F.lit(0.0), F.lit(1.0)).alias("x"), F.array(F.lit(1.0)).alias("y"))
    start = [(np.asarray([[1e-39], [0.5]], np.float32), np.zeros(1, np.float32))]
    got = training.train_jobs(training.deal(rows, "id", 1), {"it": training.Job(start)}, training.bce_loss, 1, lr=1e-45)["it"][0]
    assert got[0][0][0, 0] == 0.0 and abs(got[0][0][1, 0] - 0.5) < 1e-6


def test_a_shard_is_neither_put_together_with_others_nor_cut(spark, tmp_path):
    """Small files of many shards have a task each, and a file of several row groups has one."""
    x = np.random.default_rng(5).normal(size=(3000, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), [1.0]) for i, v in enumerate(x)], "id long, x array<float>, y array<float>")
    job = {"it": training.Job(Dense.random([40, 1], 0).layers)}

    def tasks(dealt, folder) -> dict[str, int]:
        (tmp_path / folder).mkdir()

        def make(a, b, rng):
            with open(tmp_path / folder / str(TaskContext.get().partitionId()), "a") as f:
                f.write(f"{len(a)} ")
            return a, b

        training.train_jobs(dealt, job, training.bce_loss, 1, make=make)
        return {p.name: sum(map(int, p.read_text().split())) for p in (tmp_path / folder).iterdir()}

    many = tasks(training.deal(df, "id", 12), "many")
    assert len(many) == 12 and sum(many.values()) == 3000
    conf = {n: spark.conf.get(n) for n in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("parquet.block.size", "65536")  # several row groups a file
        assert list(tasks(training.deal(df, "id", 1), "one").values()) == [3000]
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "65536"
    finally:
        spark.conf.unset("parquet.block.size")
        for n, v in conf.items():
            spark.conf.set(n, v)
