"""Windows and averages of single sensors: against a plain loop, with timers that flush and forget silent sensors."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from flowspark.sources.scratch import scratch
from flowspark.streaming import live

SCHEMA = "sensor string, t timestamp, hit boolean, n string"


def at(s):
    return None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def order(row):
    return row[0] is None, row[0] or "", row[1]


def arrive(spark, batches, idle=1800):
    """Each batch arrives and is processed; the rows written, and the sensors that the state holds at the end."""
    folder, sink, state = (scratch(spark, n) for n in ("arriving", "results", "stream"))
    for rows in batches:
        spark.createDataFrame([(k, at(s), h, "x") for k, s, h in rows], SCHEMA).repartition(3).write.mode("append").parquet(folder)
        stream = live.stream_flows(spark, folder, SCHEMA, files=None)
        got = live.run_available(live.sensor_monitor(stream, "sensor", "t", F.col("hit"), idle=idle), sink, "append", state)
    zero = int(at(0).replace(tzinfo=datetime.UTC).timestamp())
    rows = got.select("sensor", *[(F.unix_seconds(c) - zero).alias(c) for c in ("since", "end", "start")], "n_flows", "n_alerts", "rate", "ema").collect()
    assert all(r["end"] - r["start"] == 300 and r["rate"] == r["n_alerts"] / r["n_flows"] for r in rows)
    left = {r["key"]["sensor"] for r in spark.read.format("statestore").load(state).collect()}
    return sorted(((r["sensor"], r["end"], r["since"], r["n_flows"], r["n_alerts"], round(r["ema"], 9)) for r in rows), key=order), left


def expected(batches, idle=1800):
    """The same by a loop over the rows, and the sensors that are not forgotten."""
    mark, top, panes = None, None, {}
    for rows in batches:
        for k, s, h in rows:
            if s is not None and (mark is None or s // 60 * 60 > mark):
                n, a = panes.setdefault(k, {}).get(s // 60, (0, 0))
                panes[k][s // 60] = (n + 1, a + bool(h))
        top = max([s // 60 * 60 for _, s, _ in rows if s is not None] + ([] if top is None else [top]))
        mark = top - 600
    out, left = [], set()
    for k, of in panes.items():
        last = since = ema = None
        ends = sorted({p + i for p in of for i in range(5)})
        for e in (e for e in ends if e * 60 <= mark):
            n, a = (sum(of.get(p, (0, 0))[i] for p in range(e - 4, e + 1)) for i in (0, 1))
            new = last is None or e - last > idle // 60
            since, ema = (e, a / n) if new else (since, 0.7 * ema + 0.3 * a / n)
            last = e
            out.append((k, (e + 1) * 60, (since + 1) * 60, n, a, round(ema, 9)))
        if ends[-1] * 60 > mark or mark // 60 < last + idle // 60:
            left.add(k)
    return sorted(out, key=order), left


def test_windows_equal_a_plain_loop(spark):
    rng = random.Random(7)
    batches, now = [], 0
    for _ in range(4):
        rows = [(rng.choice(["a", "a", "a", "b", "", None]), now + rng.randrange(-1500, 4000), rng.choice([True, False, None])) for _ in range(120)]
        batches.append([*rows, *rows[:9], ("a", None, True)])
        now += 2500
    got, left = arrive(spark, batches)
    assert (got, left) == expected(batches)
    assert len({k for k, *_ in got}) == 4


def test_a_silent_sensor_is_flushed_then_forgotten_then_new(spark):
    batches = [
        [("quiet", 0, True), ("busy", 0, False)],
        [("busy", 1000, False)],  # flushes what is open of quiet
        [("busy", 5000, False)],  # forgets it
        [("quiet", 5000, False), ("busy", 5100, True)],
        [("busy", 6500, False)],
    ]
    first, left = arrive(spark, batches[:2])
    assert [r[1] for r in first if r[0] == "quiet"] == [60, 120, 180, 240, 300] and left == {"quiet", "busy"}
    assert (first, left) == expected(batches[:2])
    assert arrive(spark, batches[:3])[1] == {"busy"}
    got, left = arrive(spark, batches)
    assert (got, left) == expected(batches)
    assert [(r[2], r[5]) for r in got if r[0] == "quiet"][0] == (60, 1.0) and [(r[2], r[5]) for r in got if r[0] == "quiet"][-1] == (5040, 0.0)


def test_windows_are_whole_slides(spark):
    with pytest.raises(ValueError, match="whole number"):
        live.sensor_monitor(spark.createDataFrame([], SCHEMA), "sensor", "t", F.col("hit"), window=100)
