"""Operators against small truths in plain Python and NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark import spec
from flowspark.functions import scalars as S
from flowspark.operators import audit, encode, folds, metrics, profile, sampling, scoring, training
from flowspark.sources import flow_files


def test_contract_has_91_features():
    assert len(spec.CONTINUOUS) == 34 and len(spec.BINARY) == 57 and len(set(spec.FEATURES)) == 91
    assert len(spec.raw_schema()) == 55


def test_adjusted_skew_and_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,)], "x double")
    r = df.agg(profile.skewness_adjusted(F.col("x")), F.skewness("x"), F.stddev_samp("x")).first()
    assert np.allclose(r, (1.9225217, 1.1099684, 4.1932485), atol=1e-6)


def test_ema(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), ([5.0],)], "v array<double>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(folds.ema(F.col("v"))).collect()] == [1.81, None, 5.0]


def stop(curve, k, r):
    low, best, moved, bad = curve[0], 0, 0.0, 0
    for i in range(1, len(curve)):
        moved += abs(curve[i] - curve[i - 1])
        if curve[i] < low and moved > 0 and (low - curve[i]) / moved > r:
            low, best, moved, bad = curve[i], i, 0.0, 0
        else:
            bad += 1
            if bad >= k:
                break
    return best


def test_entropy_stop(spark):
    rng = np.random.default_rng(0)
    curves = [np.cumsum(rng.normal(-0.1, 1, n)).tolist() for n in rng.integers(1, 40, 40)]
    df = spark.createDataFrame(list(enumerate(curves)), "i int, c array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", folds.entropy_stop(F.col("c"), 3, 0.1).alias("s")).collect()}
    assert got == {i: stop(c, 3, 0.1) for i, c in enumerate(curves)}


def test_prefix_sum_and_ranks_with_ties_and_nulls(spark):
    values = [3.0, 1.0, 1.0, 2.0, None, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["rank"] for r in profile.average_rank(df, "v").collect()}
    assert got == {1.0: 1.5, 2.0: 4.0, 3.0: 6.0, 9.0: 7.0}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, v double, label int, attack string")
    assert profile.average_rank(df, "v").count() == 0
    assert sampling.places(df, "k", "s").count() == 0
    assert metrics.average_precision(df, "v", "label").first()[0] is None
    assert metrics.roc_auc(df, "v", "label").first()[0] is None
    assert profile.dedup_rows(df, ["v"], "k").count() == 0


def test_interpolated_quantile(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=1000).round(2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for q in (0.0, 0.123, 0.5, 0.997, 1.0):
        got = metrics.interpolated_quantile(df, "v", F.lit(q), "q").first()[0]
        assert got == pytest.approx(np.quantile(v, q), abs=1e-9)


def test_lenient_casts(spark):
    df = spark.createDataFrame([("7.9",), ("",), ("x",), (None,), ("1e30",), ("-1e30",), ("nan",)], "c string")
    got = [tuple(r) for r in df.select(S.lenient_double(F.col("c")), S.lenient_long(F.col("c"))).collect()]
    assert [g[1] for g in got] == [7, 0, 0, 0, 2**63 - 1, -(2**63), 0]
    assert [g[0] for g in got[:4]] == [7.9, 0.0, 0.0, 0.0]


def test_repaired_lines(spark):
    header = ["A", "IN_BYTES", "OUT_BYTES", flow_files.FIRST, flow_files.SECOND, "Z"]
    lines = ["1,10,20,5,6,9", "1,10,20,1,2,3,4,5,9", "1,10", "1,10,20,5,6,9,", ""]
    got = flow_files.repaired_lines(spark.createDataFrame([(x,) for x in lines], "value string"), header).collect()
    assert [r["row_status"] for r in got] == ["ok", "repaired", "short", "repaired", "short"]
    assert tuple(got[1])[:6] == ("1", "10", "20", "10", "20", "9")
    apart = [flow_files.FIRST, "IN_BYTES", "OUT_BYTES", flow_files.SECOND]
    bad = flow_files.repaired_lines(spark.createDataFrame([("1,2,3,4,5",)], "value string"), apart).first()
    assert bad["row_status"] == "unrepairable" and bad["IN_BYTES"] == "2"


def test_icmp_precedence(spark):
    rows = [(1, 8, 8 * 256), (1, 0, 5), (1, 3, 3 * 256 + 3), (1, 3, 3 * 256 + 9), (1, 3, 3 * 256 + 7), (1, 3, 3 * 256 + 16), (1, 11, 11 * 256), (1, 99, 0), (6, 8, 8 * 256), (1, None, None)]
    df = spark.createDataFrame(rows, "p int, t int, c int")
    got = [r[0] for r in df.select(encode.icmp_bucket(F.col("p") == 1, F.col("t"), F.col("c"))).collect()]
    assert got == ["icmp_echo", "icmp_nonstandard", "icmp_unreach_port", "icmp_unreach_admin", "icmp_unreach_other", "icmp_nonstandard", "icmp_time_exceeded", "icmp_other", None, "icmp_echo"]


def test_splits_are_disjoint_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"]: r["pool"] for r in sampling.three_pools(df, "k", "s", 1000, 500).collect()}
    b = {r["k"]: r["pool"] for r in sampling.three_pools(df.repartition(7), "k", "s", 1000, 500).collect()}
    assert a == b and len(a) == 5000
    assert sorted({p: sum(v == p for v in a.values()) for p in set(a.values())}.items()) == [("gradient", 3500), ("monitor", 500), ("select", 1000)]


def test_partner_is_another_row(spark):
    got = sampling.partner_join(spark.range(500).withColumnRenamed("id", "k"), "k", "s", ["k"]).collect()
    assert len(got) == 500 and all(r["k"] != r["partner_k"] for r in got)
    with pytest.raises(ValueError):
        sampling.partner_join(spark.range(1).withColumnRenamed("id", "k"), "k", "s", ["k"])


def test_injection_places(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("label"))
    bad = spark.range(5000, 5010).select(F.col("id").alias("k"), F.lit(1).alias("label"))
    got = sampling.inject_evenly(rows, bad, "k", "s", 0.05).collect()
    assert len(got) == 1000 and sum(r["label"] for r in got) == 50 == sum(r["injected"] for r in got)


def test_whitening_and_fold(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, r array<float>")
    wh = scoring.fit_whitening(df, "r")
    assert np.allclose(wh.mean, x.mean(axis=0), atol=1e-4) and 0 <= wh.shrinkage < 0.2
    assert np.allclose(wh.undo(wh.apply(x)), x, atol=1e-6)
    clf = scoring.Dense.random([8, 4, 1], 1)
    z, mean, std = rng.normal(size=(400, 3)), np.zeros(3), np.full(3, 2.0)
    plain = clf.forward(np.concatenate([(z - mean) / std, wh.apply(x)], axis=1))
    assert np.allclose(scoring.fold_affine(clf, mean, std, wh).forward(np.concatenate([z, x], axis=1)), plain, atol=1e-3)


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    df = spark.createDataFrame([(i, v.tolist(), [float(v[0] > 0)]) for i, v in enumerate(x)], "id long, x array<double>, y array<double>")
    _, history = training.train(df, scoring.Dense.random([6, 8, 1], 0).layers, training.bce_loss, "id", 4, shards=2, lr=1e-2, batch=64)
    assert history[-1] < 0.7 * history[0]


def test_bins_equal_pandas_qcut(spark):
    import pandas as pd

    v = np.random.default_rng(2).integers(0, 40, 1000).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = [r["v"] for r in audit.binned(df, ["v"], 10, ["i"]).orderBy("i").collect()]
    assert got == pd.qcut(v, 10, labels=False, duplicates="drop").tolist()


def test_checksum_of_parts(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("a"))
    whole, x, y = (flow_files.checksum(p).first() for p in (df, df.where("a = 3"), df.where("a <> 3")))
    assert tuple(whole) == tuple(i + j for i, j in zip(x, y))


def test_rank_correlations_both_ways(spark, monkeypatch):
    """From steps in every task, and by join where values are too many: equal to pandas, with gaps, ties and constants."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = pd.DataFrame({"a": rng.integers(0, 5, 400) * 1.0, "b": rng.normal(size=400), "c": 7.0, "value": rng.normal(size=400)})
    x["value"] += x["b"]
    x.loc[rng.random(400) < 0.2, "a"] = np.nan
    x.loc[rng.random(400) < 0.3, "b"] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x.to_numpy())], "id long, a double, b double, c double, value double").repartition(4)
    ranks = x.rank()  # over all rows, as the surveyed form has it
    want = {(p, q): None if "c" in (p, q) else ranks[p].corr(ranks[q]) for i, p in enumerate(x.columns) for q in x.columns[i + 1 :]}
    for most in (10**6, 1):
        monkeypatch.setattr(audit, "RANK_VALUES", most)
        for key in ("id", None):
            got = audit.rank_correlations(df, list(x.columns), key)
            assert set(got) == set(want) and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    assert audit.rank_correlations(df.where("false"), ["a", "b"]) == {("a", "b"): None}


def test_quantiles_are_the_same_either_way(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i % 3), None if i % 11 == 0 else float(v)) for i, v in enumerate(np.round(rng.normal(size=500), 1))] + [(9, None), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = [0.0, 0.013, 0.5, 0.97, 1.0, 1.5, -1.0]
    got = []
    for most in (10**6, 0):
        monkeypatch.setattr(profile, "FEW_VALUES", most)
        got.append(({r["k"]: r["q"] for r in profile.group_quantiles(df, ["k"], "v", shares).collect()}, profile.column_quantiles(df, "v", shares).first()["q"], profile.column_quantiles(df.where("false"), "v", [0.5]).first()["q"]))
    assert got[0] == got[1] and set(got[0][0]) == {0, 1, 2, None} and got[0][2] == [None] and got[0][0][None][2] == 6.0
    x = np.asarray([v for _, v in rows if v is not None])
    assert np.allclose(got[0][1][:5], np.quantile(x, shares[:5]))


def test_thresholds_for_many_budgets_equal_numpy(spark):
    import numpy as np

    from flowspark.operators import fusion

    rng = np.random.default_rng(3)
    z0, z1 = rng.normal(size=3000), np.round(rng.normal(size=3000), 2)
    z = spark.createDataFrame(list(zip(z0.tolist(), z1.tolist())), "z0 double, z1 double").repartition(5)
    alphas = [0.5, 0.001, 0.004, 0.16]
    over = z1[z0 > 1.0]
    want = [(-np.inf, True) if a * 3000 >= len(over) else (np.quantile(over, 1 - a * 3000 / len(over)), False) for a in alphas]
    got = fusion.and_thetas(z, 1.0, alphas)
    assert [c for _, c in got] == [c for _, c in want] and np.allclose([t for t, _ in got], [t for t, _ in want])
    assert fusion.and_thetas(z, 99.0, alphas) == [(np.inf, True)] * 4 and fusion.and_thetas(z, 1.0, [0.9]) == [(-np.inf, True)]
    hit = (z0 > 1.0) & (z1 > 0.5)
    targets = [0.2, 0.0001, 0.06, 1.0]
    left = [t * 3000 - hit.sum() for t in targets]
    want = [np.quantile(z1[~hit], 1 - x / (~hit).sum()) if x > 0 else np.inf for x in left]
    assert np.allclose(fusion.union_thetas(z, 1.0, 0.5, targets), want) and fusion.union_theta(z, 1.0, 0.5, 0.0001) == np.inf
    assert fusion.union_thetas(z, -99.0, -99.0, [1.0]) == [np.inf]
