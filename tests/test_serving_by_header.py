"""Captures by their own headers, explained alerts, sinks that runs can repeat, streams that fail and go on."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark import spec
from flowspark.operators import joins, metrics, profile, sampling
from flowspark.plans import serving
from flowspark.sources import flow_files, model_files
from flowspark.streaming import live

LABELLED = serving.LABELLED
# the two series stand together in every order, so that lines can be repaired
REORDERED = ["Attack", *[c for c in reversed(spec.RAW_COLUMNS) if c not in (flow_files.FIRST, flow_files.SECOND)], flow_files.FIRST, flow_files.SECOND, "Label"]


def alerts_of(df):
    return sorted((r["mode"], r["branch"], r["row_status"], r["IPV4_SRC_ADDR"], r["FLOW_START_MILLISECONDS"], r["L4_DST_PORT"], round(r["logit"], 4)) for r in df.collect())


@pytest.fixture(scope="module")
def model_folder(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('model')}/m"
    model_files.write_model(spark, serving.untrained_model(), folder)
    return folder


def test_captures_in_any_order_give_the_same_alerts(spark, data, tmp_path, model_folder):
    got = {}
    for name, header in {"plain": spec.RAW_COLUMNS, "labelled": LABELLED, "reordered": REORDERED}.items():
        path = f"file://{tmp_path}/{name}"
        serving.write_captures(serving.captured_lines(spark, data, header), header, path)
        serving.write_captures(serving.captured_lines(spark, data, header), header, f"file://{tmp_path}/mixed", "append")
        got[name] = alerts_of(serving.run(spark, path, model_folder, f"file://{tmp_path}/sink-{name}"))
    assert got["plain"] == got["labelled"] == got["reordered"] and len(got["plain"]) > 20
    assert {a[2] for a in got["plain"]} == {"ok", "repaired"}
    # three layouts in one folder
    assert alerts_of(serving.run(spark, f"file://{tmp_path}/mixed", model_folder, f"file://{tmp_path}/sink-mixed")) == sorted(got["plain"] * 3)

    def capture(name, header, lines=("1,2,3",)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text("\n".join([",".join(header), *lines]) if header else "\n".join(lines))
        return f"file://{tmp_path}/{name}"

    run = lambda path: serving.run(spark, path, model_folder, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="unknown columns .'WHAT'"):
        run(capture("unknown", [*spec.RAW_COLUMNS, "WHAT"]))
    with pytest.raises(ValueError, match="missing columns .'PROTOCOL'"):
        run(capture("missing", [c for c in spec.RAW_COLUMNS if c != "PROTOCOL"]))
    with pytest.raises(ValueError, match="unknown columns"):
        run(capture("first", ["WHAT", *spec.RAW_COLUMNS[1:]]))
    with pytest.raises(ValueError, match="header of a capture"):
        run(capture("twice", [*spec.RAW_COLUMNS, "PROTOCOL"]))
    with pytest.raises(ValueError, match="1 files have no header"):
        run(capture("headless", None))


def test_a_run_that_is_repeated_writes_no_second_alert(spark, data, tmp_path, model_folder):
    path, sink = f"file://{tmp_path}/captured", f"file://{tmp_path}/sink"
    serving.write_captures(serving.captured_lines(spark, data), spec.RAW_COLUMNS, path)
    first = alerts_of(serving.run(spark, path, model_folder, sink))
    assert alerts_of(serving.run(spark, path, model_folder, sink)) == first == alerts_of(spark.read.parquet(sink))
    serving.run(spark, path, model_folder, sink, batch="other")
    assert spark.read.parquet(sink).count() == 2 * len(first) and len(serving.run(spark, path, model_folder, sink, mode="A").collect()) < len(first)


def test_alerts_are_explained(spark, data, tmp_path, model_folder):
    path = f"file://{tmp_path}/captured"
    serving.write_captures(serving.captured_lines(spark, data), spec.RAW_COLUMNS, path)
    model = serving.untrained_model()
    got = serving.run(spark, path, model_folder, f"file://{tmp_path}/sink").collect()
    flows = flow_files.captured_flows(flow_files.capture_lines(spark, path))
    from flowspark.operators.encode import flow_encode

    x = {(r["IPV4_SRC_ADDR"], r["FLOW_START_MILLISECONDS"], r["L4_DST_PORT"], r["PROTOCOL"]): np.asarray(r["x"], np.float32) for r in flow_encode(flows, model.scaler, model.log_features, keep=serving.KEEP).collect()}
    assert got and all(r["why"] for r in got)
    for r in got[:30]:
        v = x[r["IPV4_SRC_ADDR"], r["FLOW_START_MILLISECONDS"], r["L4_DST_PORT"], r["PROTOCOL"]][None]
        z = (model.ae.forward(v)[1] - v - model.whitening.mean)[0] / model.whitening.sigma
        far = {spec.FEATURES[i] for i in np.flatnonzero(np.abs(z) > 3)} or {spec.FEATURES[int(np.abs(z).argmax())]}
        assert {w["feature"] for w in r["why"]} == far
        for f in r["families"]:
            own = [abs(z[i]) for i, n in enumerate(spec.FEATURES) if spec.FAMILY.get(n, "other") == f["family"]]
            assert math.isclose(f["z"], max(own), rel_tol=1e-3, abs_tol=1e-4)


def test_detection_by_class(spark, data):
    report = serving.serve_detection_report(spark, data)
    rows = {(r["mode"], r["attack"]): r for r in report.collect()}
    flows = serving._raw(spark, data).groupBy("Attack").count().collect()
    assert {(m, r["Attack"]) for m in "AB" for r in flows} == set(rows)
    assert all(rows[m, r["Attack"]]["n"] == r["count"] for m in "AB" for r in flows)
    assert all(0 <= r["alarms"] <= r["n"] and 0 <= r["first_stage"] <= r["n"] for r in rows.values()) and sum(r["alarms"] for r in rows.values()) > 0
    rates = {(r["mode"], r["stage"]): r for r in serving.rates_of_report(report).collect()}
    for m in "AB":
        bad = sum(r["alarms"] for k, r in rows.items() if k[0] == m and k[1] != "Benign")
        assert rates[m, "fused"]["tp"] == bad and rates[m, "fused"]["fp"] == rows[m, "Benign"]["alarms"] and rates[m, "first stage"]["fp"] == rows[m, "Benign"]["first_stage"]


def test_retention_by_bytes(spark, tmp_path):
    sink = f"file://{tmp_path}/sink"
    for batch in ("a", "b"):
        flow_files.write_alerts(spark.range(300).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("day")), sink, batch)
    size = {r["day"]: 0 for r in flow_files.alert_manifest(spark, sink).collect()}
    for r in flow_files.alert_manifest(spark, sink).collect():
        size[r["day"]] += r["bytes"]
    assert flow_files.keep_newest_days(spark, sink, sum(size.values())) == []
    assert flow_files.keep_newest_days(spark, sink, size["2024-01-02"] + size["2024-01-03"]) == ["2024-01-01"]
    assert spark.read.parquet(sink).count() == 400 and flow_files.keep_newest_days(spark, sink, 0) == ["2024-01-02"]


def test_a_stream_that_fails_goes_on_and_writes_each_alert_once(spark, tmp_path):
    """One file fails before its alerts are written, another after; each start goes on from the checkpoint."""
    arriving, sink, state = (f"file://{tmp_path}/{n}" for n in ("arriving", "sink", "state"))
    for i in range(4):
        spark.range(i * 100, i * 100 + 100).coalesce(1).write.mode("append").parquet(arriving)
    failures = {"before": 1, "after": 1}
    stream = lambda: live.stream_flows(spark, arriving, "id long")

    def score(batch):
        n = batch.agg(F.min("id")).first()[0]
        if n == 100 and failures["before"]:
            failures["before"] = 0
            raise RuntimeError("lost before")
        return batch.where("id % 10 = 0")

    write = spark.createDataFrame

    def marked(rows, schema=None, *a, **k):
        if schema == "batch long" and rows[0][0] == 2 and failures["after"]:
            failures["after"] = 0
            raise RuntimeError("lost after")
        return write(rows, schema, *a, **k)

    spark.createDataFrame = marked
    try:
        failed = live.keep_running(lambda: live.score_to_alerts(stream(), score, sink, state), wait=0)
    finally:
        del spark.createDataFrame
    assert failed >= 1 and not failures["before"]
    got = live.read_alerts(spark, sink)
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 400, 10)) and got.select("batch").distinct().count() == 4
    live.keep_running(lambda: live.score_to_alerts(stream(), score, sink, state))
    assert live.read_alerts(spark, sink).count() == 40
    with pytest.raises(Exception, match="always"):
        live.keep_running(lambda: live.score_to_alerts(stream(), lambda b: (_ for _ in ()).throw(RuntimeError("always")), f"{sink}2", f"{state}2"), attempts=2, wait=0)


def test_rows_are_told_apart(spark):
    a = spark.createDataFrame([("x\x1f1y", "z", 1), ("x", "y\x1f1z", 2), (None, "", 3), ("", None, 4), ("ab", "c", 5), ("a", "bc", 6)], "p string, q string, _key int")
    got = joins.anti_join_rows(a, a.where("_key IN (2, 3, 5)"), ["p", "q"]).collect()
    assert {r["_key"] for r in got} == {1, 4, 6}
    nan, inf = float("nan"), float("inf")
    b = spark.createDataFrame([(0.0, 1), (-0.0, 2), (nan, 3), (None, 4), (inf, 5), (0.5, 6)], "v double, k int")
    assert {r["k"] for r in joins.anti_join_rows(b, b.where("k IN (2, 3)"), ["v"]).collect()} == {4, 5, 6}
    ints = spark.createDataFrame([(0,), (5,)], "v int")
    assert {r["k"] for r in joins.anti_join_rows(b, ints, ["v"]).collect()} == {3, 4, 5, 6}
    split = sampling.cluster_split(spark.createDataFrame([(i, "x\x1f1y" if i % 2 else "x", "z" if i % 2 else "y\x1f1z", i % 2, "c" if i % 2 else "Benign") for i in range(40)], "id long, p string, q string, label int, cls string"), ["p", "q"], "id", "label", "cls", "s")
    assert {r["split"] for r in split.where("id % 2 = 1").collect()} <= {"val", "test"} and len({r["split"] for r in split.where("id % 2 = 0").collect()}) == 1


def test_helper_columns_do_not_clash(spark):
    names = ["place", "_hit", "_i", "_donor", "_a_x", "hit", "nth", "_first", "first", "_n", "n", "_k", "_p", "key", "_key", "one", "two", "_in_a"]
    df = spark.range(60).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 2).alias("label"), *[F.lit(i).alias(c) for i, c in enumerate(names)])
    ben, att = df.where("label = 0"), df.where("label = 1")
    got = sampling.inject_evenly(ben, att, "id", "s", 0.3)
    assert got.columns == [*df.columns, "injected"] and got.where("injected").count() == 9 and got.where("place <> 0").count() == 0
    assert profile.dedup_rows(df, ["x", *names], "id").orderBy("x").select("id").collect() == [(i,) for i in range(7)]
    assert profile.majority_class(df.withColumn("_n", F.lit("v")), ["x"], "_n").count() == 7
    assert metrics.curves(df.withColumn("_k", F.col("x") * 1.0), "_k", "label").count() == 7
    assert sampling.leak_report(df, "label", ["_n"]).first()["n_shared"] == 1
    assert sampling.column_permute(df, "id", ["place", "x"], "s").count() == 60
    diff = {r["column"]: r["n_different"] for r in flow_files.compare_frames(df, df.withColumn("one", F.when(F.col("id") < 5, 1).otherwise(F.col("one"))), ["id"]).collect()}
    assert diff["one"] == 5 and sum(diff.values()) == 5


def test_equal_features_keep_the_least_label(spark):
    from flowspark.operators.encode import flow_encode_fit
    from flowspark.plans.flow_view import flows

    df = flows(spark, "/root/testdata/sf0.001").drop("flow_id", "start_ms", "s_dae", "logit", "pool").withColumnsRenamed({"label": "Label", "attack": "Attack"})
    twice = df.withColumns({"Label": F.lit(1), "Attack": F.lit("z")}).unionByName(df.withColumns({"Label": F.lit(0), "Attack": F.lit("b")})).unionByName(df.withColumns({"Label": F.lit(0), "Attack": F.lit("a")}))
    coded, _ = flow_encode_fit(twice.repartition(7))
    assert {(r["Label"], r["Attack"]) for r in coded.select("Label", "Attack").distinct().collect()} == {(0, "a")}


def test_runs_are_found_by_their_folders(spark, tmp_path):
    for rate, lr, seed in (("0.10", "1e-3", 7), ("0.1", "0.001", 12)):
        folder = tmp_path / f"rate_{rate}" / f"lr_{lr}"
        folder.mkdir(parents=True)
        (folder / f"seed_{seed}.json").write_text('{\n "H": [1.5, 2.5],\n "ap": [0.25]\n}')
    got = {(r["rate"], r["lr"], r["seed"]): (r["H"], r["ap"]) for r in flow_files.read_runs(spark, f"file://{tmp_path}", "H array<double>, ap array<double>").collect()}
    assert got == {("0.10", "1e-3", "7"): ([1.5, 2.5], [0.25]), ("0.1", "0.001", "12"): ([1.5, 2.5], [0.25])}
