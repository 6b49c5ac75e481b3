"""The live path as Structured Streaming: files in, alerts and rates out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.encode import feature_family
from ..operators.profile import apart, confusion_counts, prefix_sum
from ..operators.scoring import explained
from ..spec import REPLAY_SIZES


def stream_flows(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int | None = 1, clean: str | None = None, **options) -> DataFrame:
    """Files of a folder as they arrive, so many per batch (None: all that are there); clean='delete' removes finished ones."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    for name, value in (("maxFilesPerTrigger", files), ("cleanSource", clean)):
        reader = reader.option(name, value) if value else reader
    return reader.load(folder)


def alert_rates(stream: DataFrame, time: str, alarm: Column, window: str = "300 seconds", slide: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, end, n_flows, n_alerts, rate) in event time; rows later than `late` are dropped."""
    got = stream.withWatermark(time, late).groupBy(F.window(time, window, slide)).agg(F.count("*").alias("n_flows"), F.count_if(alarm).alias("n_alerts"))
    return got.select("window.start", "window.end", "n_flows", "n_alerts", (F.col("n_alerts") / F.col("n_flows")).alias("rate"))


def running_confusion(stream: DataFrame, label: str, alarm: Column) -> DataFrame:
    """tp, fp, tn, fn so far; write in complete mode."""
    return stream.groupBy().agg(*confusion_counts(F.col(label), alarm))


def stream_ema(stream: DataFrame, key: str, rate: str, alpha: float = 0.3) -> DataFrame:
    """(key, ema) after each batch: the mean rate of a batch's rows is folded once; the state is one number a key.

    Each task sums its own rows per key first, so that only sums reach the task of a key.
    """
    kind = dict(stream.dtypes)[key]

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            by = part.groupby(key, dropna=False)[rate]
            yield pd.DataFrame({"total": by.sum(), "n": by.count()}).reset_index()

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = n = 0
        for part in parts:
            total, n = total + float(part["total"].sum()), n + int(part["n"].sum())
        now = state.get[0] if state.exists else None
        if n:
            now = total / n if now is None else (1 - alpha) * now + alpha * total / n
        if now is not None:
            state.update((now,))
            yield pd.DataFrame({key: [k[0]], "ema": [now]})

    summed = stream.select(key, F.col(rate).cast("double").alias(rate)).mapInPandas(sums, f"{key} {kind}, total double, n long")
    return summed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ema double", "ema double", "update", "NoTimeout")


def sensor_monitor(stream: DataFrame, key: str, time: str, alarm: Column, window: int = 300, slide: int = 60, late: int = 600, idle: int = 86_400, alpha: float = 0.3) -> DataFrame:
    """(key, since, start, end, n_flows, n_alerts, rate, ema): the sliding windows of every sensor, each once, as the watermark passes
    its last pane of `slide` seconds; write in append mode. All times are those of the events.

    ema folds the rates of a sensor's windows in order of time. A sensor that falls silent gets its last windows from a timer; `idle` seconds
    after the last of them it is forgotten, and a window beyond that starts a new average; since: the end of the first window of the average. Rows of
    panes behind the watermark are dropped (count_late counts such rows), as are rows without a time or from before 1970; a null alarm is none. The
    state of a sensor is its open panes and the average. Tasks count their own rows per sensor and pane first, so that only counts of a
    busy sensor reach its task.
    """
    if window % slide or min(window, slide, idle) <= 0:
        raise ValueError("a window is a whole number of slides")
    kind, k, rest = dict(stream.dtypes)[key], window // slide, -(-idle // slide)
    counted = f"sensor {kind}, pane long, n long, a long"

    def panes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby(["sensor", "pane"], dropna=False, as_index=False).agg(n=("n", "sum"), a=("a", "sum"))

    def update(sensor: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n, a, last, since, ema = state.get if state.exists else ([], [], [], None, None, None)
        rows = pd.concat([pd.DataFrame({"pane": list(at), "n": list(n), "a": list(a)}, dtype="int64"), *(p[["pane", "n", "a"]] for p in parts)])
        rows = rows.groupby("pane", as_index=False).sum()
        at, n, a = (rows[c].to_numpy(np.int64) for c in ("pane", "n", "a"))
        closed = state.getCurrentWatermarkMs() // (slide * 1000)
        ends = np.unique(at[:, None] + np.arange(k))
        ends = ends if last is None else ends[ends > last]
        now = ends[ends <= closed]
        lo, hi = np.searchsorted(at, now - k, "right"), np.searchsorted(at, now, "right")
        n_flows, n_alerts = (np.concatenate(([0], np.cumsum(x))) for x in (n, a))
        n_flows, n_alerts = n_flows[hi] - n_flows[lo], n_alerts[hi] - n_alerts[lo]
        out = []
        for e, rate in zip(now.tolist(), (n_alerts / n_flows).tolist()):
            if last is None or e - last > rest:
                since, ema = e, rate
            else:
                ema = (1 - alpha) * ema + alpha * rate
            out.append((since, ema))
            last = e
        if len(now):
            yield pd.DataFrame({"sensor": pd.Series([sensor[0]] * len(now), dtype=object), "since": [s for s, _ in out], "pane": now, "n": n_flows, "a": n_alerts, "ema": [m for _, m in out]})
        waiting = ends[ends > closed]
        if not len(waiting) and (last is None or closed >= last + rest):
            if state.exists:
                state.remove()
            return
        open_ = at > closed - k + 1  # panes of windows that are still open
        state.update((at[open_].tolist(), n[open_].tolist(), a[open_].tolist(), last, since, ema))
        state.setTimeoutTimestamp(int(waiting[0] if len(waiting) else last + rest) * slide * 1000 - 1)

    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = stream.select(F.col(key).alias("sensor"), F.floor(seconds / slide).cast("long").alias("pane"), F.lit(1).cast("long").alias("n"), F.coalesce(alarm, F.lit(False)).cast("long").alias("a"))
    per = rows.where("pane >= 0").mapInPandas(panes, counted).withColumn("t", F.timestamp_seconds(F.col("pane") * slide)).withWatermark("t", f"{late} seconds")
    got = per.groupBy("sensor").applyInPandasWithState(
        update, f"sensor {kind}, since long, pane long, n long, a long, ema double", "at array<long>, n array<long>, a array<long>, last long, since long, ema double", "append", "EventTimeTimeout"
    )
    end = lambda c: F.timestamp_seconds((F.col(c) + 1) * slide)
    start = F.timestamp_seconds((F.col("pane") + 1) * slide - window)
    return got.select(F.col("sensor").alias(key), end("since").alias("since"), start.alias("start"), end("pane").alias("end"), F.col("n").alias("n_flows"), F.col("a").alias("n_alerts"), (F.col("a") / F.col("n")).alias("rate"), "ema")


def alert_rows(scored: DataFrame, alarm: Column, zr: str, names: list[str], limit: float, keep: list[str]) -> DataFrame:
    """(keep, why): flagged rows with the features beyond the limit, their values and families."""
    why = F.transform(explained(F.col(zr), names, limit), lambda p: F.struct(p["feature"].alias("feature"), p["z"].alias("z"), feature_family(p["feature"]).alias("family")))
    return scored.where(alarm).select(*keep, why.alias("why"))


def score_to_alerts(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Scores every batch and writes its alerts. Every batch has a folder of its own, and a mark once it is
    whole; a batch that is run again, after a failure at any point, replaces its folder, so each alert is there once (read_alerts)."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done = batch.sparkSession.createDataFrame([(number,)], "batch long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{sink}.done/number={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_alerts(spark: SparkSession, sink: str) -> DataFrame:
    """The alerts of all batches that are whole, with the number of the batch."""
    done = [r["batch"] for r in spark.read.schema("batch long").parquet(f"{sink}.done").collect()]  # one row a batch
    return spark.read.option("basePath", sink).parquet(*[f"{sink}/batch={n}" for n in sorted(done)])


def keep_running(start: Callable[[], StreamingQuery], attempts: int = 5, wait: float = 1.0) -> int:
    """Runs a stream to the end of what has arrived; one that fails is started again from its checkpoint after `wait`
    seconds, up to `attempts` times. Returns how often it failed; the last failure is raised."""
    for failed in range(attempts):
        try:
            start().awaitTermination()
            return failed
        except StreamingQueryException:
            if failed + 1 == attempts:
                raise
            time.sleep(wait)
    raise ValueError("no attempt allowed")


def run_available(stream: DataFrame, sink: str, mode: str, checkpoint: str) -> DataFrame:
    """All that has arrived, as the rows that the stream wrote to the folder `sink`.

    Each batch has its own folder, which a repeated batch overwrites; in complete mode the last batch is
    the result, in update mode the number of the batch is a column. Nothing passes through the driver.
    """
    spark, name = stream.sparkSession, apart(stream.columns, "batch")[0]
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{sink}/{name}=-1")  # a stream without rows has a result too

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{name}={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(sink).where(f"`{name}` >= 0")
    return got if mode == "update" else got.select(stream.columns)


def windows_of(df: DataFrame, order: str, tie: str, sizes: list[int] = REPLAY_SIZES, target: int | None = None) -> DataFrame:
    """df with window and place: rows in order of (order, tie) cut into windows of these sizes, which come round again; rows
    come round too until `target` rows are placed (once, without a target). Places come from prefix sums over the order."""
    at, before, n = apart(df.columns, "at", "before", "n")
    per = prefix_sum(df.groupBy(order).agg(F.count("*").alias(n)), order, {n: before}).drop(n)
    placed = df.join(per.hint("shuffle_hash"), order).withColumn(at, F.col(before) + F.row_number().over(W.partitionBy(order).orderBy(tie)) - 1)
    total = df.count() if target is not None else 0
    if target is not None and total:
        round_ = F.explode(F.sequence(F.lit(0), F.floor((F.lit(target - 1) - F.col(at)) / total)))
        placed = placed.where(F.col(at) < target).withColumn(before, round_).withColumn(at, F.col(at) + F.col(before) * total)
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    inside = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col(at) % ends[-1]))
    window = F.floor(F.col(at) / ends[-1]) * len(sizes) + inside
    return placed.select(*df.columns, window.cast("long").alias("window"), F.col(at).cast("long").alias("place"))


class WindowNumbers(DataSource):
    """A stream of the numbers 0, 1, ... of windows, `step` (1) a batch; its offset is the number of windows gone by."""

    @classmethod
    def name(cls) -> str:
        return "window_numbers"

    def schema(self) -> str:
        return "window long"

    def streamReader(self, schema):  # noqa: N802
        return _WindowReader(int(self.options["windows"]), int(self.options.get("step", 1)))


class _WindowReader(DataSourceStreamReader):
    def __init__(self, windows: int, step: int) -> None:
        self.windows, self.step, self.at = windows, step, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.step, self.windows)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list:
        self.at = max(self.at, end["at"])  # after a restart the next offset follows the last one
        return [InputPartition((start["at"], end["at"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(*partition.value):
            yield (i,)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["at"])


def replay(windows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, batches: int | None = None) -> None:
    """Every window (of windows_of, written) as a batch of a stream, in order; each(batch, number of the batch). With `batches`, a batch
    takes as many whole windows in a row as it needs for there to be no more than that. A batch reads the files that may hold its windows,
    so tables written in order of the window are read once in all. A replay that is started again goes on behind the last batch that was done."""
    spark = windows.sparkSession
    spark.dataSource.register(WindowNumbers)
    n = windows.agg(F.max("window")).first()[0]
    if n is None:
        return
    step = -(-(n + 1) // batches) if batches else 1

    def take(numbers: DataFrame, number: int) -> None:
        low, high = numbers.agg(F.min("window"), F.max("window")).first()
        each(windows.where(F.col("window").between(low, high)), number)

    numbers = spark.readStream.format("window_numbers").option("windows", n + 1).option("step", step).load()
    query = numbers.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def count_late(stream: DataFrame, time: str, sink: str, checkpoint: str, window: int = 300, slide: int = 60, late: int = 600) -> StreamingQuery:
    """Counts, by batch, rows and those of them that every window has closed to (alert_rates drops these): the watermark of a batch is
    the latest time of the batches before it less `late` seconds. Rows: batch, n, late, last. A batch that is run again replaces its row."""

    def each(batch: DataFrame, number: int) -> None:
        last = None
        if number:
            done = batch.sparkSession.read.schema("number long, n long, late long, last double").parquet(sink)
            last = done.where(F.col("number") < number).agg(F.max("last")).first()[0]
        t = F.unix_micros(time) / 1e6
        mark = F.lit(None if last is None else last - late).cast("double")
        gone = F.floor(t / slide) * slide + window <= mark
        got = batch.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("n"), F.count_if(gone).alias("late"), F.max(t).alias("last"))
        got.coalesce(1).write.mode("overwrite").parquet(f"{sink}/number={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
