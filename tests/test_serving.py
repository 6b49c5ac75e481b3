"""The serving job end to end against NumPy, model folders, and CSV files by name."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark import spec
from flowspark.operators import encode
from flowspark.plans import serving
from flowspark.sources import flow_files, model_files


def expected(spark, data, model):
    """(mode, branch, row_status) -> alerts, by plain NumPy from the encoded rows."""
    rows = flow_files.repaired_lines(serving.captured_lines(spark, data), spec.RAW_COLUMNS)
    got = encode.flow_encode(rows, model.scaler, keep=("row_status",)).collect()
    x = np.asarray([r["x"] for r in got], np.float32)
    relu = lambda v: np.maximum(v, 0)
    h = x
    for w, b in model.ae.encoder.layers:
        h = relu(h @ w + b)
    z, y = h, h
    for i, (w, b) in enumerate(model.ae.decoder.layers):
        y = y @ w + b if i == 2 else relu(y @ w + b)
    n = model.ae.n_linear
    y = np.concatenate([y[:, :n], 1 / (1 + np.exp(-y[:, n:]))], axis=1)
    s = ((y - x)[:, n:] ** 2).mean(axis=1)
    h = np.concatenate([(z - model.z_mean) / model.z_std, (y - x - model.whitening.mean) @ model.whitening.factor], axis=1)
    for i, (w, b) in enumerate(model.clf.layers):
        h = h @ w + b if i == 2 else relu(h @ w + b)
    out = {}
    for mode, p in model.decision.items():
        z0, z1 = (np.log10(np.maximum(s, 1e-12)) - p["mu"][0]) / p["sd"][0], (h[:, 0] - p["mu"][1]) / p["sd"][1]
        both = (z0 > p["tau_z"]) & (z1 > p["theta_z"])
        logit = z1 > (np.inf if p["theta_union"] is None else p["theta_union"])
        first = z0 > p["tau_hi_z"]
        for r, a, b, c in zip(got, both, logit, first):
            if a or b or c:
                key = (mode, "consensus" if a else "logit" if b else "first stage", r["row_status"])
                out[key] = out.get(key, 0) + 1
    return out


def test_serving_job_against_numpy(spark, data):
    want = expected(spark, data, serving.untrained_model())
    assert {k[2] for k in want} == {"ok", "repaired"} and len({k[1] for k in want}) >= 2 and {k[0] for k in want} == {"A", "B"}
    for job in (serving.serve_flow_alerts, serving.serve_flow_stream):
        got = {(r["mode"], r["branch"], r["row_status"]): r["n"] for r in job(spark, data).collect()}
        # single precision: a flow at a threshold may fall on either side
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_model_folders(spark, tmp_path):
    model = serving.untrained_model()
    model.whitening.mean = np.arange(91.0)
    (tmp_path / "plain").mkdir()
    for name, content in model_files.model_files(model).items():
        (tmp_path / "plain" / name).write_bytes(content)
    model_files.write_model(spark, model, f"{tmp_path}/table")
    x = np.random.default_rng(0).normal(size=(5, 91)).astype(np.float32)
    for folder in ("plain", "table"):
        got = model_files.read_model(spark, f"{tmp_path}/{folder}")
        assert all(np.allclose(a, b) for a, b in zip(got.ae.forward(x), model.ae.forward(x)))
        phi = np.ones((2, 107), np.float32)
        assert np.allclose(got.clf.forward(phi), model.clf.forward(phi)) and np.allclose(got.whitening.mean, model.whitening.mean)
        assert got.scaler == model.scaler and got.decision == model.decision and got.log_features == model.log_features
        assert model_files.decision_of(got.parameters(spark)) == model.decision
    (tmp_path / "plain" / "pa.npz").unlink()
    with pytest.raises(FileNotFoundError, match="pa.npz"):
        model_files.read_model(spark, f"{tmp_path}/plain")


def test_csv_columns_go_by_name(spark, tmp_path):
    value = {c: str(i) for i, c in enumerate(spec.RAW_COLUMNS)} | {"IPV4_SRC_ADDR": "10.0.0.1", "IPV4_DST_ADDR": "10.0.0.2", "Label": "1", "Attack": "dos"}
    orders = {"exported": [*spec.RAW_COLUMNS, "Label", "Attack"], "other": ["Attack", *reversed(spec.RAW_COLUMNS), "Label"]}
    for name, order in orders.items():
        (tmp_path / f"{name}.csv").write_text(",".join(order) + "\n" + ",".join(value[c] for c in order) + "\n")
        r = flow_files.read_flows_csv(spark, f"{tmp_path}/{name}.csv").first()
        assert list(r.asDict()) == [*spec.RAW_COLUMNS, "Label", "Attack"]
        assert (r["IPV4_SRC_ADDR"], r["PROTOCOL"], r["IN_BYTES"], r["Label"], r["Attack"]) == ("10.0.0.1", 4, 6, 1, "dos")
        assert flow_files.read_flows_csv(spark, f"{tmp_path}/{name}.csv", ["OUT_BYTES"]).first()["OUT_BYTES"] == 7
    (tmp_path / "bad.csv").write_text(",".join([*spec.RAW_COLUMNS[:-1], "WHAT", "Label", "Attack"]) + "\n")
    with pytest.raises(ValueError, match="WHAT.*DST_TO_SRC_IAT_STDDEV"):
        flow_files.read_flows_csv(spark, f"{tmp_path}/bad.csv")
    with pytest.raises(Exception, match="CSV header"):
        flow_files.read_flows_csv(spark, [f"{tmp_path}/exported.csv", f"{tmp_path}/other.csv"]).collect()


def test_every_feature_has_a_family(spark):
    names = [*spec.FEATURES, "MIN_TTL", "TCP_WIN_MAX_IN", "no_such"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["f"] for r in df.select("n", encode.feature_family(F.col("n"), {"no_such": "made"}).alias("f")).collect()}
    assert got["port_dns"] == got["L4_DST_PORT"] == "port" and got["DNS_TTL_ANSWER"] == "DNS" and got["SRC_TO_DST_SECOND_BYTES"] == "throughput"
    assert got["LONGEST_FLOW_PKT"] == "packet size" and got["MAX_TTL"] == "TTL" and got["has_ttl"] == "field presence" and got["no_such"] == "made"
    assert "other" not in got.values()
