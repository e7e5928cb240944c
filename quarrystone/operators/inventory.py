"""Run inventory: jobs by time, completion matrices, phases and timings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.constants import JOB_SECONDS
from quarrystone.functions.text import context_of_file, file_type, model_of_file, project_of_file, run_of_file, time_of_file
from quarrystone.operators.work import few


def registry(files: DataFrame, path: str) -> DataFrame:
    """Metadata of files from their names: type, project, model, context, run and time."""
    d = files.withColumn("file", F.regexp_extract(path, "([^/]*)$", 1)).withColumn("model", model_of_file(path))
    return d.withColumn("type", file_type(path)).withColumn("project", project_of_file(path)).withColumn("context", context_of_file(path, "model")).withColumn("run", run_of_file(path)).withColumn("time", time_of_file("file"))


def anchored_jobs(rows: DataFrame, key: str, time: str, order: str, seconds: int = JOB_SECONDS) -> DataFrame:
    """Adds ``job``, numbered within the key: a job takes rows up to ``seconds`` after its first row.

    The jobs depend on each other, so a key's rows pass in order through one task, which holds a batch;
    rows without a time go.
    """
    micros = f"_{uuid.uuid4().hex}"
    ordered = rows.filter(F.col(time).isNotNull()).withColumn(micros, F.unix_micros(F.col(time).cast("timestamp")))
    ordered = ordered.repartition(key).sortWithinPartitions(key, micros, order)
    at = ordered.columns.index(key)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, job = None, None, 0
        for b in batches:
            jobs = []
            for k, t in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if first is None or k != now:
                    now, first, job = k, t, 1
                elif t - first > seconds * 1_000_000:
                    first, job = t, job + 1
                jobs.append(job)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(jobs, pa.int64())], [*b.schema.names[:-1], "job"])

    return ordered.mapInArrow(f, T.StructType([*rows.schema.fields, T.StructField("job", T.LongType())]))


def completion_matrix(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence, run: str) -> DataFrame:
    """Distinct runs by keys and ``column``, one column for each of its given values, 0 where there is none."""
    return rows.groupBy(*keys).pivot(column, list(values)).agg(F.countDistinct(run)).na.fill(0)


def missing_combinations(sides: Sequence[DataFrame], actual: DataFrame) -> DataFrame:
    """Combinations of the sides' few values, a thousand rows a side at most behind the first, that ``actual`` lacks."""
    grid = sides[0]
    for s in sides[1:]:
        rows = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, s.schema)]) for r in few(s, 1_000)])
        grid = grid.select("*", F.inline(rows))
    return grid.join(actual.select(*grid.columns).distinct(), grid.columns, "left_anti")


def phase_roi(phases: DataFrame, phase: str, added: Column, seconds: str, order: str) -> DataFrame:
    """Net values added, velocity a minute and share of the time by phase; ``best`` marks the first fastest."""
    d = phases.groupBy(phase).agg(F.sum(F.greatest(added, F.lit(0))).alias("net_added"), F.sum(seconds).alias("seconds"), F.min(order).alias("first"))
    d = d.withColumn("velocity", F.when(F.col("seconds") > 0, F.col("net_added") * 60 / F.col("seconds")).otherwise(0.0))
    # Phases are few: their total and best are one row.
    all_ = d.agg(F.sum("seconds").alias("_all"), F.max_by(phase, F.struct("velocity", -F.col("first"))).alias("_best"))
    d = d.join(F.broadcast(all_), F.lit(True))
    return d.select(phase, "net_added", "seconds", "velocity", F.when(F.col("_all") > 0, F.col("seconds") * 100 / F.col("_all")).otherwise(0.0).alias("time_pct"), (F.col(phase) == F.col("_best")).alias("best"))


def timing_stats(calls: DataFrame, key: str, seconds: str) -> DataFrame:
    """Calls, mean and population deviation; no deviation of a single call."""
    d = calls.groupBy(key).agg(F.count(seconds).alias("calls"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("_sd"))
    return d.withColumn("sd", F.when(F.col("calls") > 1, F.col("_sd"))).drop("_sd").orderBy(F.desc("total"), key)


def family_totals(calls: DataFrame, name: str, families: Sequence[str], value: Column) -> DataFrame:
    return calls.agg(*[F.coalesce(F.sum(F.when(F.lower(name).contains(f), value)), F.lit(0)).alias(f) for f in families])


def class_counts(files: DataFrame, path: str) -> DataFrame:
    return files.groupBy(file_type(path).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def stalled(gaps: Sequence[int], least: int = 2, rounds: int = 3) -> bool:
    """Whether the last ``rounds`` iterations each closed fewer than ``least`` gaps."""
    closed = [a - b for a, b in zip(gaps, gaps[1:])]
    return len(closed) >= rounds and all(c < least for c in closed[-rounds:])


def stalls(rounds: DataFrame, key: str, order: str, gaps: str, least: int = 2, times: int = 3) -> DataFrame:
    """Adds ``closed``, the gaps that a round closed, and ``stalled``: it and the rounds before, ``times`` in all, each closed fewer than ``least``."""
    w = Window.partitionBy(key).orderBy(order)
    d = rounds.withColumn("closed", F.lag(gaps).over(w) - F.col(gaps))
    few_closed = F.sum(F.coalesce((F.col("closed") < least).cast("int"), F.lit(0))).over(w.rowsBetween(1 - times, 0))
    return d.withColumn("stalled", few_closed == times)


def first_gaps(gaps: DataFrame, key: str, order: str, most: int = 15) -> DataFrame:
    """The first ``most`` gaps of each round in scan order, which are searched."""
    w = Window.partitionBy(key).orderBy(order)
    return gaps.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def sampled_peaks(series: DataFrame, key: str, value: str) -> DataFrame:
    """Samples, peak and mean of a sampled series; marks that are no numbers do not count."""
    v = F.col(value).cast("string").try_cast("double")
    return series.groupBy(key).agg(F.count(v).alias("samples"), F.max(v).alias("peak"), F.avg(v).alias("mean"), F.count_if(v.isNull()).alias("marks"))


def carry_forward(lines: DataFrame, key: str, order: str, mark: Column, name: str) -> DataFrame:
    """Last mark at or before each line of its file."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(mark, ignorenulls=True).over(w))


def islands(lines: DataFrame, key: str, order: str, inside: Column, name: str = "island") -> DataFrame:
    """Numbers stretches of lines inside; null for lines outside."""
    w = Window.partitionBy(key).orderBy(order)
    d = lines.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    return d.withColumn("_s", starts.cast("long")).withColumn(name, F.when(F.col("_in"), F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_in", "_s")
