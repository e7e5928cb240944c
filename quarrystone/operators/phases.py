"""Counts and times of the phases of a chain, gathered while it runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .work import folder, written

REPORT = "phase string, place int, rows long, seconds double, metrics map<string,double>"


class Phases:
    """Runs phases one after another; each is one job that writes its result to the shared folder.

    Rows, and further metrics (columns of aggregates), are observed in that job, so nothing is read or computed a second
    time for the report.
    """

    def __init__(self, metrics: Mapping[str, Column] | None = None):
        self.metrics, self.rows = dict(metrics or {}), []

    def run(self, name: str, df: DataFrame, metrics: Mapping[str, Column] | None = None) -> DataFrame:
        """The phase's result, as written."""
        seen, own = Observation(f"{name} {len(self.rows)}"), self.metrics | dict(metrics or {})
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(f"m {k}") for k, c in own.items()])
        start = time.perf_counter()
        out = written(watched, folder(df.sparkSession), f"phase-{len(self.rows)}")
        got = seen.get
        self.rows.append((name, len(self.rows), got["rows"], time.perf_counter() - start, {k: got[f"m {k}"] for k in own}))
        return out

    def chain(self, df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
        for name, step in steps:
            df = self.run(name, step(df))
        return df

    def report(self, spark) -> DataFrame:
        """(phase, place, rows, seconds, metrics), one row for each phase that ran."""
        return spark.createDataFrame(self.rows, REPORT)
