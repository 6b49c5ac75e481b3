"""Cases that earlier cuts of the queries lost."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowspark import plans


def test_bootstrap_takes_every_trial(spark):
    from flowspark.plans.profiles import trials

    d = "/root/testdata/sf0.01"
    t = trials(spark, d).toPandas()
    order = t.groupby("trial").metric.mean().reset_index().sort_values(["metric", "trial"], ascending=[False, True]).trial
    m = t.pivot(index="trial", columns="seed", values="metric").reindex(index=order, columns=range(1, 13)).fillna(0.0).to_numpy()
    assert len(m) > 50
    place = [int(m[:, np.random.default_rng(i).integers(0, 12, 12)].mean(axis=1).argmax()) + 1 for i in range(500)]
    want = {k: n / 500 for k, n in zip(*np.unique(place, return_counts=True))}
    assert max(want) > 50
    assert {r["k"]: r["chance"] for r in plans.QUERIES["u16_bootstrap_means"](spark, d).collect()} == want


def test_every_class_is_left_out_once_a_seed(spark, data, tmp_path):
    """Four attack classes, where the given tables have two."""
    label = F.when(F.col("vec_id") % 5 == 0, 1).otherwise(5 * (F.col("vec_id") % 5)).cast("int")
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    e.withColumn("label", label.cast(dict(e.dtypes)["label"])).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["excluded"], r["seed"]) for r in plans.QUERIES["m19_leave_one_class_out_fit"](spark, str(tmp_path)).collect())
    assert got == [(c, s) for c in (5, 10, 15, 20) for s in (1, 2)]


def test_ema_folds_one_rate_per_batch(spark, tmp_path):
    from flowspark.streaming import live

    rates = {}
    for b, bits in enumerate(([1, 0, 0, 0], [1, 1, 0, 0], [1, 1, 1, 0, 0])):
        spark.createDataFrame([("s", float(x)) for x in bits], "sensor string, rate double").coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
        rates[b] = sum(bits) / len(bits)
    stream = live.stream_flows(spark, f"{tmp_path}/in/*", "sensor string, rate double")
    got = live.run_available(live.stream_ema(stream, "sensor", "rate"), f"{tmp_path}/out", "update", f"{tmp_path}/at").orderBy("batch").collect()
    want, now = [], None
    for r in rates.values():
        now = r if now is None else 0.7 * now + 0.3 * r
        want.append(round(now, 9))
    assert [round(r["ema"], 9) for r in got] == want
