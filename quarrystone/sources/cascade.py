"""Prompts answered by several providers in turn, with the health of each kept from batch to batch.

Distinct prompts are dealt to batches by their digest; a batch is one Spark job.  In a task, prompts go to
the first provider of the present order, those without an answer to the next, and so on.  Calls that failed
or took too long are strikes against a provider; the counts, a row for each provider, go to the driver after each
batch, and a provider with enough strikes goes to the end of the order for some batches.  It is still asked
last, so that the order never decides whether a prompt is answered.

Answers are kept by prompt in a versioned table, so no prompt is asked again in a later attempt, batch or
run.  A task that is lost and run again asks its prompts again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.work import folder, written

from .providers import Provider
from .store import Store

#: Prompts that a provider is asked at once; a task holds no more of its calls than these.
CALL_PROMPTS = 256
TRIES = "prompt string, provider string, answer string, seconds double, bad boolean"


@dataclass
class Health:
    """Order of the providers by their strikes; nothing of it depends on the number of prompts."""

    names: list[str]
    most_strikes: int = 2
    cooldown: int = 2
    strikes: dict[str, int] = field(default_factory=dict)
    resting: dict[str, int] = field(default_factory=dict)

    def order(self) -> list[str]:
        """Those that rest come last, who has rested longest first."""
        return [n for n in self.names if n not in self.resting] + sorted((n for n in self.names if n in self.resting), key=lambda n: (self.resting[n], self.names.index(n)))

    def after(self, bad: dict[str, int]) -> None:
        """Takes note of a batch's bad calls."""
        self.resting = {n: k - 1 for n, k in self.resting.items() if k > 1}
        for n in self.names:
            self.strikes[n] = self.strikes.get(n, 0) + bad.get(n, 0)
            if self.strikes[n] >= self.most_strikes and len(self.names) > 1:
                self.strikes[n], self.resting[n] = 0, self.cooldown


class Cascade:
    """Several named providers behind one ``apply``; calls of all tries are in ``tries``."""

    def __init__(self, providers: Sequence[tuple[str, Provider]], store: Store, slow_after: float = 50.0, most_strikes: int = 2, cooldown: int = 2, batches: int = 8, memo: str = "answers"):
        self.providers, self.store, self.slow_after, self.batches, self.memo = dict(providers), store, slow_after, batches, memo
        self.health = Health(list(self.providers), most_strikes, cooldown)
        self.tries: list[DataFrame] = []

    def _ask(self, prompts: DataFrame, order: list[str]) -> DataFrame:
        providers, slow = [(n, self.providers[n]) for n in order], self.slow_after

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, CALL_PROMPTS):
                    left = b.column(0).slice(lo, CALL_PROMPTS).to_pylist()
                    for name, provider in providers:
                        if not left:
                            break
                        start = time.perf_counter()
                        try:
                            got = provider.timed(left)
                        except Exception:  # a provider that breaks has answered none of them
                            got = [(None, (time.perf_counter() - start) / len(left))] * len(left)
                        told = [(p, name, a, s, a is None or s > slow) for p, (a, s) in zip(left, got)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*told), kinds)], names)
                        left = [p for p, (a, _) in zip(left, got) if a is None]

        names, kinds = ["prompt", "provider", "answer", "seconds", "bad"], [pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
        return prompts.mapInArrow(f, TRIES)

    def known(self) -> DataFrame:
        """(prompt, answer) of all prompts answered so far."""
        found = self.store.read(self.memo)
        return self.store.spark.createDataFrame([], "prompt string, answer string") if found is None else found

    def apply(self, rows: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
        """Adds answers; null prompts have none, prompts that no provider answers neither."""
        spark, path = rows.sparkSession, folder(rows.sparkSession)
        part = F.pmod(F.conv(F.substring(F.md5(F.col("prompt").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(self.batches))
        asked = rows.select(F.col(prompt).alias("prompt")).filter("prompt IS NOT NULL").distinct()
        # A written table: the batches read their own folder each, and see one and the same set of prompts.
        asked.withColumn("batch", part).write.partitionBy("batch").parquet(f"{path}/asked")
        asked = spark.read.schema("prompt string, batch int").parquet(f"{path}/asked")
        for k in range(self.batches):
            new = asked.filter(F.col("batch") == k).select("prompt").join(self.known().select("prompt"), "prompt", "left_anti")
            tries = written(self._ask(new, self.health.order()), path, f"tries-{k}-{uuid.uuid4().hex}")
            self.tries.append(tries)
            bad = tries.groupBy("provider").agg(F.sum(F.col("bad").cast("long")).alias("n")).collect()
            self.store.update(self.memo, lambda _, got=tries: got.filter("answer IS NOT NULL").select("prompt", "answer"), append=True)
            self.health.after({r["provider"]: r["n"] for r in bad})
        known = self.known().select(F.col("prompt").alias("_prompt"), F.col("answer").alias(answer))
        return rows.join(known, F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")

    def calls(self) -> DataFrame:
        """(provider, calls, failures, slow) of all tries of this cascade."""
        rows = self.store.spark.createDataFrame([], TRIES)
        for t in self.tries:
            rows = rows.unionByName(t)
        count = lambda c: F.sum(c.cast("long"))
        return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), count(F.col("answer").isNull()).alias("failures"), count(F.col("seconds") > self.slow_after).alias("slow"))


def shortened(context: Column, most: int) -> Column:
    """A context's first characters, marked where there were more."""
    return F.when(F.length(context) > most, F.concat(F.substring(context, 1, most), F.lit("... [TRUNCATED]"))).otherwise(context)


def with_answers(rows: DataFrame, cascade: Cascade, prompt: Callable[[Column], Column], context: str, lengths: Sequence[int], accept: Callable[[Column], Column] = lambda a: a.isNotNull(), key: str = "id") -> DataFrame:
    """Adds ``answer`` and ``attempt`` (from 1): a further attempt with a shorter context where an answer is not accepted.

    ``key`` names rows; those that no attempt answers have nulls.
    """
    path, done, left = folder(rows.sparkSession), [], rows
    for k, most in enumerate(lengths):
        text = prompt(shortened(F.coalesce(F.col(context), F.lit("")), most))
        got = written(cascade.apply(left.select(F.col(key).alias("_key"), text.alias("_prompt_text")).distinct(), "_prompt_text", "answer").select("_key", "answer"), path, f"attempt-{k}")
        fine = F.coalesce(accept(F.col("answer")), F.lit(False))
        done.append(got.filter(fine).select("_key", "answer", F.lit(k + 1).alias("attempt")))
        left = left.join(got.filter(~fine).select("_key").distinct(), F.col(key) == F.col("_key"), "left_semi")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # Rows that share a key but not a context keep the answer of the first attempt that has one.
    found = found.groupBy("_key").agg(F.min(F.struct("attempt", "answer")).alias("_found"))
    return rows.join(found, F.col(key) == F.col("_key"), "left").select(*rows.columns, "_found.answer", "_found.attempt")
