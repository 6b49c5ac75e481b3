"""Windows of given sizes as batches of a stream, and late rows that are counted."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from flowspark.sources.scratch import scratch, written
from flowspark.spec import REPLAY_SIZES
from flowspark.streaming import live


def test_windows_follow_the_sizes_and_come_round(spark):
    df = spark.range(23).select("id", (F.col("id") % 4).alias("t"), F.lit("x").alias("n")).repartition(5)
    order = sorted(range(23), key=lambda i: (i % 4, i))
    got = live.windows_of(df, "t", "id", [3, 1, 5]).orderBy("place").collect()
    assert [r["id"] for r in got] == order and got[0].asDict().keys() == {"id", "t", "n", "window", "place"}
    sizes = [3, 1, 5, 3, 1, 5, 3, 1, 1]
    assert [r["window"] for r in got] == [w for w, k in enumerate(sizes) for _ in range(k)]
    more = live.windows_of(df, "t", "id", [3, 1, 5], 50).orderBy("place").collect()
    assert [r["id"] for r in more] == (order * 3)[:50] and [r["place"] for r in more] == list(range(50)) and more[-1]["window"] == 17
    assert [r["id"] for r in live.windows_of(df, "t", "id", target=4).orderBy("place").collect()] == order[:4]
    assert len(REPLAY_SIZES) == 50 and live.windows_of(df.where("false"), "t", "id").count() == 0


def test_a_replay_goes_on_where_it_ended(spark):
    cut = written(live.windows_of(spark.range(20).withColumn("t", F.col("id")), "t", "id", [4, 1, 7]), "windows")
    seen: list[tuple[int, list[int]]] = []
    state = scratch(spark, "state")

    def each(batch, number):
        ids = sorted(r["id"] for r in batch.collect())
        if number == 2 and not any(n == 2 for n, _ in seen):
            seen.append((2, []))
            raise RuntimeError("lost")
        seen.append((number, ids))

    with pytest.raises(Exception, match="lost"):
        live.replay(cut, each, state)
    live.replay(cut, each, state)
    done = {n: ids for n, ids in seen if ids}
    assert done == {0: [0, 1, 2, 3], 1: [4], 2: list(range(5, 12)), 3: [12, 13, 14, 15], 4: [16], 5: [17, 18, 19]} and len([n for n, ids in seen if ids]) == 6
    live.replay(cut, each, state)
    assert len([n for n, ids in seen if ids]) == 6


def test_late_rows_are_counted(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    folder, sink, state = (scratch(spark, n) for n in ("arriving", "late", "state"))
    batches = [[0, 100, 5000], [4399, 4400, 4099, 3000, 9000, None], [8000, 8090, 8400, 7000]]
    for part in batches:
        spark.createDataFrame([(None if s is None else at(s),) for s in part], "t timestamp").coalesce(1).write.mode("append").parquet(folder)
        live.count_late(live.stream_flows(spark, folder, "t timestamp", files=None), "t", sink, state).awaitTermination()
    got = {r["batch"]: (r["n"], r["late"]) for r in spark.read.parquet(sink).collect()}
    late = [0, sum(s is not None and s // 60 * 60 + 300 <= 5000 - 600 for s in batches[1]), sum(s // 60 * 60 + 300 <= 9000 - 600 for s in batches[2])]
    assert got == {i: (len(p), n) for i, (p, n) in enumerate(zip(batches, late, strict=True))} and late[1] == 2 and late[2] == 3


def test_batches_take_runs_of_whole_windows(spark):
    """Many windows end in a bounded number of batches, in order; a batch that failed is taken up again."""
    cut = written(live.windows_of(spark.range(300).withColumn("t", F.col("id")), "t", "id", [2, 1]), "windows")
    seen: list[tuple[int, list[tuple[int, int]]]] = []
    state = scratch(spark, "state")

    def each(batch, number):
        if number == 3 and not any(n == 3 for n, _ in seen):
            seen.append((3, []))
            raise RuntimeError("lost")
        seen.append((number, sorted((r["window"], r["id"]) for r in batch.collect())))

    with pytest.raises(Exception, match="lost"):
        live.replay(cut, each, state, batches=7)
    live.replay(cut, each, state, batches=7)
    done = [rows for _, rows in seen if rows]
    assert [n for n, rows in seen if rows] == list(range(7)) and [i for rows in done for _, i in rows] == list(range(300))
    assert [sorted({w for w, _ in rows}) for rows in done] == [list(range(k, min(k + 29, 200))) for k in range(0, 200, 29)]
