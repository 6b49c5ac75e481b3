"""Ranks over tables with copies, against their SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark import plans
from flowspark.operators import audit
from flowspark.plans import audits, models


def _copied_suppliers(spark, data, folder):
    """lineitem with each supplier twenty times under other keys, rows in another order for each."""
    t = spark.read.parquet(f"{data}/lineitem.parquet").crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    t = t.withColumn("l_suppkey", F.col("l_suppkey") + F.col("copy") * 1000).orderBy(F.xxhash64("copy", "l_orderkey", "l_linenumber"))
    t.drop("copy").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("name", ["w03_rank_metrics", "w04_rank_movement"])
def test_ranks_of_equal_trials_do_not_hang_on_the_order_of_sums(spark, data, tmp_path, name):
    _copied_suppliers(spark, data, tmp_path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(db.sql(plans.ORACLE_SQL[name]).fetchall())
    got = sorted(tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect())
    assert len(got) > 100 and got == want


def test_draws_leave_a_task_as_one_row_each():
    """The best trial of every draw by brute force; what leaves a task does not grow with its trials."""
    rng = np.random.default_rng(0)
    counts = np.stack([np.bincount(rng.integers(0, 12, 12), minlength=12) for _ in range(30)])
    seeds = np.repeat(rng.random((700, 12)).round(2), 3, axis=0)  # every trial three times
    trial, m = rng.permutation(len(seeds)), seeds.mean(axis=1).round(1)
    batches = [pa.record_batch([pa.array(trial[i : i + 900]), pa.array(m[i : i + 900]), pa.array(seeds[i : i + 900].tolist())], ["trial", "m", "seeds"]) for i in range(0, len(seeds), 900)]
    (got,) = models.best_of_draws(counts)(iter(batches))
    assert got.num_rows == 30
    for r in got.to_pylist():
        mean = sum(counts[r["draw"], k] * seeds[:, k] for k in range(12)) / 12
        assert (r["mean"], r["m"], -r["trial"]) == max(zip(mean.tolist(), m.tolist(), (-trial).tolist()))


def test_label_correlations_join_no_ranks_to_rows(spark, monkeypatch):
    """rho against pandas with ties, missing values and labels, a constant column; rows are never joined with ranks of their values."""
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"id": np.arange(4000), "a": rng.integers(0, 50, 4000).astype(float), "b": rng.random(4000), "c": 1.0, "y": rng.integers(0, 3, 4000).astype(float)})
    p.loc[p.y == 2, "b"] += 0.2
    p.loc[rng.random(4000) < 0.1, "a"] = None
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "id long, a double, b double, c double, y double")
    monkeypatch.setattr(audit, "ranked", lambda *a: pytest.fail("ranks joined to rows"))
    monkeypatch.setattr(audit, "RANK_VALUES", 0)
    got = {r["feature"]: r["rho"] for r in audit.spearman_label(df, ["a", "b", "c"], "id", "y", 0.0).collect()}
    r = p.rank()  # missing values have no rank
    want = {c: r[c].corr(r.y) for c in ("a", "b")}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    lost = df.withColumn("y", F.when(F.col("id") % 7 > 0, F.col("y")))
    got = {r["feature"]: r["rho"] for r in audit.spearman_label(lost, ["a", "b"], "id", "y", 0.0).collect()}
    p.loc[p.id % 7 == 0, "y"] = None
    r = p.rank()
    want = {c: r[c].corr(r.y) for c in ("a", "b")}
    assert all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_the_audit_report_derives_flows_once(spark, data, monkeypatch):
    calls = []
    real = audits.written
    monkeypatch.setattr(audits, "written", lambda df, name: (calls.append(name), real(df, name))[1])
    assert plans.QUERIES["d13_audit_report"](spark, data).count() == 12 and calls == ["flows"]


def test_only_columns_of_many_values_are_joined_and_frequent_values_are_spread(spark, monkeypatch):
    """rho against pandas where one column has too many values for a table, most rows one of them, some none and some not a number."""
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"few": rng.integers(0, 4, 3000) * 1.0, "many": np.where(rng.random(3000) < 0.8, 0.5, rng.random(3000)), "value": rng.integers(0, 9, 3000) * 1.0})
    p["many"] += p["few"] * (p["many"] != 0.5)
    rows = [(*r,) for r in p.values.tolist()]
    df = spark.createDataFrame([(a, None if i % 50 == 0 else float("nan") if i % 51 == 0 else b, c) for i, (a, b, c) in enumerate(rows)], "few double, many double, value double").repartition(3)
    p["many"] = [None if i % 50 == 0 else np.inf if i % 51 == 0 else b for i, b in enumerate(p["many"])]  # not a number is the largest in Spark
    asked, real, made = [], audit.ranked, []

    def ranked(rows, col, counts):
        asked.append(col)
        made.append(real(rows, col, counts))
        return made[-1]

    monkeypatch.setattr(audit, "ranked", ranked)
    monkeypatch.setattr(audit, "RANK_VALUES", 50)
    monkeypatch.setattr(audit, "HOT_SHARE", 100)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = audit.rank_correlations(df, list(p.columns))
        assert asked == ["many"]
        parts = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    r = p.rank()
    assert all(abs(got[a, b] - r[a].corr(r[b])) < 1e-9 for a, b in got)
    assert sum(parts) == 3000 and max(parts) < 1500
