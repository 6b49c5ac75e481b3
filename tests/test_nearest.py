"""Exact nearest vectors with pruning, against all distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark.operators import joins


def brute(rows, points, k, own):
    out = {}
    for i, x in rows:
        near = sorted((float(np.sqrt(((np.asarray(x) - np.asarray(p)) ** 2).sum())), j) for j, p in points if not (own and i == j))[:k]
        if near:
            out[i] = near
    return out


def check(spark, x, share, k, own, block, monkeypatch, rows_at_once=50):
    monkeypatch.setattr(joins, "ROWS", rows_at_once)
    vectors = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    points = [v for v in vectors if v[0] % share == 0]
    df = spark.createDataFrame(vectors, "id long, v array<double>").repartition(5)
    got, counts = joins.nearest_pruned(df, df.where(F.col("id") % share == 0), "id", "v", k, own, block)
    want = brute(vectors, points, k, own)
    found = {r["id"]: [(p["distance"], p["nearest"]) for p in r["nearest"]] for r in got.collect()}
    assert set(found) == set(want)
    for i, near in want.items():
        assert len(found[i]) == len(near) and np.allclose([d for d, _ in found[i]], [d for d, _ in near], atol=1e-5)
    return found, want, counts


def test_most_blocks_are_skipped_where_vectors_cluster(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(0, 100, (25, 8)), 40, axis=0) + rng.normal(0, 1, (1000, 8))
    found, want, counts = check(spark, x, 1, 3, True, 40, monkeypatch)
    assert all([j for _, j in found[i]] == [j for _, j in want[i]] for i in want)
    assert counts["pairs"] >= 1000 * 25 and counts["met"] < 0.2 * counts["pairs"]


@pytest.mark.parametrize("kind", ["even", "equal", "line"])
def test_no_neighbour_is_lost(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    x = {"even": rng.normal(size=(300, 16)), "equal": np.where(np.arange(300)[:, None] % 3 > 0, 1.0, rng.normal(size=(300, 4))), "line": np.arange(300.0)[:, None] * [1, 0]}[kind]
    found, want, _ = check(spark, x, 2, 4, True, 30, monkeypatch)
    if kind != "even":  # ties go to the smaller id
        assert all([j for _, j in found[i]] == [j for _, j in want[i]] for i in want)
    check(spark, x, 2, 1, False, 30, monkeypatch)


def test_few_reference_vectors(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(12, 3))
    check(spark, x, 5, 7, True, 2, monkeypatch)  # fewer than k
    check(spark, x, 12, 2, True, 2, monkeypatch)  # its own only neighbour: absent
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert joins.nearest(df, df.where("false"), "id", "v").collect() == [] and joins.nearest(df.where("false"), df, "id", "v").collect() == []


def test_rows_move_once_for_tens_of_thousands_of_reference_vectors(spark):
    x = np.random.default_rng(4).normal(size=(5000, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    got, counts = joins.nearest_pruned(df, df, "id", "v", 1, True)
    assert counts == {"pairs": 5000, "met": 5000}  # one block, where rows of 4,000 made each row move to several
    x = x.astype(np.float32).astype(float)
    d = ((x[:50, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(50), np.arange(50)] = np.inf
    found = {r["id"]: r["nearest"][0] for r in got.where("id < 50").collect()}
    assert [found[i]["nearest"] for i in range(50)] == d.argmin(axis=1).tolist()
    assert np.allclose([found[i]["distance"] for i in range(50)], np.sqrt(d.min(axis=1)), rtol=1e-12)


@pytest.mark.parametrize("at", [0.0, 1e4])
def test_copies_are_equally_far_and_go_by_id(spark, monkeypatch, at):
    x = at + np.random.default_rng(5).normal(size=(12, 32))
    found, want, _ = check(spark, np.repeat(x, 25, axis=0), 1, 6, True, 40, monkeypatch)
    assert all(found[i] == [(0.0, j) for _, j in near] for i, near in want.items())


def test_vectors_that_are_not_finite_hide_no_other(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(200, 4)))]
    bad = [(1000 + i, [c, 0.0, 0.0, 0.0]) for i, c in enumerate([float("nan"), float("inf"), None])] + [(1003, None)]
    df = spark.createDataFrame(good + bad, "id long, v array<double>").repartition(3)
    got = {r["id"]: [p["nearest"] for p in r["nearest"]] for r in joins.nearest(df.where("id < 1000"), df, "id", "v", 3, True, 20).collect()}
    assert got == {i: [j for _, j in near] for i, near in brute(good, good, 3, True).items()}


def test_a_row_is_written_once_whatever_number_of_blocks_it_may_need():
    pivots = np.eye(4) * 10
    table = np.asarray([(c, 0.0, 1.0) for c in range(4)])
    rows = pa.record_batch([pa.array([1, 2, 3]), pa.array([[10.0, 0, 0, 0], [0.0, 9, 0, 0], [0.0, 0, 10, 0]]), pa.array([None, 0.5, 20.0])], ["id", "v", "far"])
    got = [r for b in joins._blocks_of(pivots, table, False)(iter([rows])) for r in b.to_pylist()]
    assert [(r["id"], r["blocks"]) for r in got] == [(1, [1, 2, 3]), (3, [0, 1, 3])]
    home = [r for b in joins._blocks_of(pivots, table, True)(iter([rows])) for r in b.to_pylist()]
    assert [(r["id"], r["blocks"]) for r in home] == [(1, [0]), (2, [1]), (3, [2])]


@pytest.mark.parametrize("k", [1, 2, 6])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_candidates_of_pieces_are_those_of_the_whole_matrix(k, kind):
    rng = np.random.default_rng(7)
    left, right = rng.normal(size=(50, 9)).astype(kind), rng.normal(size=(9, 1003)).astype(kind)
    pieces, s = [right[:, c : c + 100] for c in range(0, 1003, 100)], left @ right
    limit = np.where(np.arange(50) % 2, np.inf, np.sort(s, axis=1)[:, 0] - 1.0)
    at = joins._candidates(left, pieces, k, limit, np.full(50, 1e-3), 50 * 1003)
    got = np.zeros(s.size, bool)
    got[at] = True
    # all of the k least within the limit, and few others
    assert got.reshape(s.shape)[s <= np.minimum(np.sort(s, axis=1)[:, k - 1], limit)[:, None]].all()
    assert not got.reshape(s.shape)[::2].any() and len(at) == len(set(at)) <= 25 * 4 * k
    assert joins._candidates(left, pieces, k, np.full(50, np.inf), np.full(50, 1e3), 1000) is None


def test_coverage_metrics_search_once(spark, monkeypatch):
    from flowspark.plans import audits

    calls = []
    real = joins.nearest_pruned
    monkeypatch.setattr(joins, "nearest_pruned", lambda *a: calls.append(a) or real(*a))
    assert audits.d23(spark, "/root/testdata/sf0.001").count() == 1 and len(calls) == 1
