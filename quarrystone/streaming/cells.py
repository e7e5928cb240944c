"""Streams: catalog cells under guarded updates, sampled series and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrystone.functions.constants import JOB_SECONDS, LOCK, MISSING_CELL

_MISSING = frozenset(MISSING_CELL)


def take(state: tuple[str, float], value: str | None, confidence: float, lock: float = LOCK) -> tuple[str, float]:
    """The cell after one update."""
    empty, new_empty = state[0] in _MISSING, (value or "") in _MISSING
    if state[1] >= lock and not empty:
        return state
    return (value or "", confidence) if (empty and not new_empty) or (not empty and confidence > state[1]) else state


def upsert_stream(updates: DataFrame, key: str = "key", order: str = "ord", lock: float = LOCK) -> DataFrame:
    """Cells of a stream of updates (key, ord, value, confidence): state per key, changed cells come out.

    Updates of one micro-batch are applied by ``order``; across batches in order of arrival.
    """

    def f(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cell = start = tuple(state.get) if state.exists else ("[missing]", 0.0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for value, confidence in zip(rows["value"], rows["confidence"]):
            cell = take(cell, value, float(confidence), lock)
        state.update(cell)
        if cell != start:
            yield pd.DataFrame({"key": [k[0]], "value": [cell[0]], "confidence": [cell[1]]})

    typed = updates.select(F.col(key).cast("string").alias("key"), F.col(order).alias(order), F.col("value").cast("string").alias("value"), F.col("confidence").cast("double").alias("confidence"))
    return typed.groupBy("key").applyInPandasWithState(f, "key string, value string, confidence double", "value string, confidence double", "update", GroupStateTimeout.NoTimeout)


def anchored_jobs_stream(runs: DataFrame, key: str, time: str, order: str, seconds: int = JOB_SECONDS) -> DataFrame:
    """Jobs of a stream of runs (key, order, time): a job takes runs up to ``seconds`` after its first one.

    The state of a key is its job's number and first time.  Runs of one micro-batch are taken by time and
    ``order``; across batches in order of arrival, so one that comes late counts to the job that is open.
    """

    def f(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, first = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["t", "o"], kind="stable")
        jobs = []
        for t in rows["t"].tolist():
            if not job or t - first > seconds * 1_000_000:
                job, first = job + 1, t
            jobs.append(job)
        state.update((job, first))
        yield pd.DataFrame({"key": [k[0]] * len(jobs), "o": rows["o"].to_numpy(), "job": jobs})

    typed = runs.filter(F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    return typed.groupBy("key").applyInPandasWithState(f, "key string, o long, job long", "job long, first long", "append", GroupStateTimeout.NoTimeout)


class _JobsInOrder(StatefulProcessor):
    """Waiting runs by event time, and the open job; one timer a key, at its earliest waiting run."""

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, o long")
        self.open = handle.getValueState("open", "job long, first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.waiting.exists()
        first = min(int(t) for t, _ in self.waiting.get()) if held else None
        new = [(int(t), int(o)) for b in rows for t, o in zip(b["t"], b["o"])]
        self.waiting.appendList(new)
        earliest = min(t for t, _ in new)
        if first is None or earliest < first:
            if first is not None:
                self.handle.deleteTimer(first // 1000 + 1)
            self.handle.registerTimer(earliest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that lies before the watermark is there, as later rows from before it are dropped.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(t), int(o)) for t, o in self.waiting.get())
        ready, rest = [r for r in rows if r[0] < until], [r for r in rows if r[0] >= until]
        job, first = map(int, self.open.get()) if self.open.exists() else (0, 0)
        jobs = []
        for t, _ in ready:
            if not job or t - first > self.span:
                job, first = job + 1, t
            jobs.append(job)
        self.open.update((job, first))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if jobs:
            yield pd.DataFrame({"key": [str(key[0])] * len(jobs), "o": [o for _, o in ready], "job": jobs})

    def close(self) -> None:
        pass


def ordered_jobs_stream(runs: DataFrame, key: str, time: str, order: str, seconds: int = JOB_SECONDS, late: str = "1 hour") -> DataFrame:
    """Jobs of a stream of runs (key, order, time) as the batch gives them, whatever the order in which runs come.

    A run waits in its key's state until the watermark, ``late`` behind the latest run of all, has passed it; a timer then
    takes all such runs in order of time and ``order``.  Runs that come later than that are dropped.  The session
    needs the state store of Spark's ``RocksDBStateStoreProvider``.
    """
    typed = runs.filter(F.col(time).isNotNull()).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    typed = typed.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"), F.unix_micros("_at").alias("t"), "_at")
    return typed.groupBy("key").transformWithStateInPandas(_JobsInOrder(seconds), "key string, o long, job long", "Append", "EventTime")


def not_cooling(calls: DataFrame, key: str, time: str, order: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    """Calls of a stream whose key made no other accepted call within ``seconds`` before; others are refused.

    A key is forgotten when the watermark has passed the end of its cooldown.
    """

    def f(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "o"], kind="stable")
        taken = []
        for t, o in zip(rows["t"].tolist(), rows["o"].tolist()):
            if until is None or t >= until:
                until = t + int(seconds * 1_000_000)
                taken.append((k[0], o, t))
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(taken, columns=["key", "o", "t"])

    typed = calls.filter(F.col(time).isNotNull()).withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("o"), F.col(time), F.unix_micros(F.col(time)).alias("t"))
    return typed.groupBy("key").applyInPandasWithState(f, "key string, o long, t long", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def read_series(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream of sampled CSV files."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(path)


def numeric_samples(series: DataFrame, value: str) -> DataFrame:
    """Samples with a number; marks of a dead source go."""
    return series.withColumn(value, F.col(value).cast("string").try_cast("double")).filter(F.col(value).isNotNull())


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def unseen(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what is there to its end into a memory table, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
