"""Scoring of competing extraction runs: facts, votes, adjudication, confusion counts, leaderboards.

A fact is one extracted cell: project, dataset, field, model, run, value.  All operators are
aggregations and equi joins on those keys, so they partition by them; none gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import normalize, or_not_specified
from quarrystone.functions.values import adjudicated, status

HALLUCINATED = "HALLUCINATED_DATASET"
REAL = "REAL_DISCOVERY"


def melt(wide: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    """Long form of ``fields``, as text; rows whose normal form is empty go."""
    long = wide.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in fields]).unpivot(list(keys), list(fields), name, value)
    return long.withColumn("norm_value", normalize(value)).filter("norm_value <> ''")


def run_numbers(files: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``run``, 1 to n within the keys in order of ``order``."""
    return files.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def jury_vote(facts: DataFrame, keys: Sequence[str], value: str = "norm_value") -> DataFrame:
    """Votes of each value of a cell and its share; null keys and values do not vote."""
    votes = facts.dropna(subset=[*keys, value]).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    return votes.withColumn("total_votes", F.sum("votes").over(Window.partitionBy(*keys))).withColumn("vote_pct", F.col("votes") / F.col("total_votes"))


def consensus(voted: DataFrame, keys: Sequence[str], value: str = "norm_value") -> DataFrame:
    """The value with most votes, the smallest of those that tie."""
    first = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.asc(value))
    return voted.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def reality(facts: DataFrame, dataset: str, config: str, run: str) -> DataFrame:
    """Verdict on each dataset: found by at least three runs and 15 % of all."""
    total = facts.select(config, run).dropna().distinct().agg(F.count(F.lit(1)).alias("total_runs"))
    found = facts.dropna(subset=[config, run]).groupBy(dataset).agg(F.countDistinct(config, run).alias("runs"))
    # One row, so broadcast it.
    joined = found.join(F.broadcast(total), F.lit(True))
    return joined.withColumn("verdict", F.when(F.col("runs") >= F.greatest(F.lit(3.0), F.col("total_runs") * 0.15), REAL).otherwise(HALLUCINATED))


def without_agent_finds(facts: DataFrame, known: DataFrame, dataset: str, source: str) -> DataFrame:
    """Drops facts of datasets not known that an agent's research found."""
    marked = facts.join(known.select(F.col(dataset).alias("_known")).distinct(), F.col(dataset) == F.col("_known"), "left")
    by_agent = F.coalesce(F.col(source).rlike("(?i)deep research|agent"), F.lit(False))
    return marked.filter(F.col("_known").isNotNull() | ~by_agent).drop("_known")


def adjudicate(voted: DataFrame, golden: DataFrame, keys: Sequence[str], value: str = "norm_value", golden_value: str = "golden", hallucinated: Column | None = None) -> DataFrame:
    """Truth and action of each cell that the vote or the golden table has; null keys meet null keys."""
    left = voted.select(*[F.col(k).alias(f"_v_{k}") for k in keys], value, "vote_pct")
    right = golden.select(*[F.col(k).alias(f"_g_{k}") for k in keys], golden_value)
    on = [F.col(f"_v_{k}").eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    both = left.join(right, on, "full_outer").select(*[F.coalesce(f"_v_{k}", f"_g_{k}").alias(k) for k in keys], value, "vote_pct", golden_value)
    verdict = adjudicated(F.col(golden_value), F.col(value), F.col("vote_pct"), F.lit(False) if hallucinated is None else hallucinated)
    return both.withColumn("_a", verdict).select(*keys, value, golden_value, "vote_pct", F.col("_a.truth").alias("truth"), F.col("_a.action").alias("action"))


def presence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of both tables and ``both``, ``left_only`` or ``right_only``; null keys meet null keys."""
    a = left.select(*[F.col(k).alias(f"_a_{k}") for k in keys]).withColumn("_a", F.lit(True))
    b = right.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).withColumn("_b", F.lit(True))
    joined = a.join(b, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys], "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return joined.select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], side.alias("side"))


def last_wins(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """One value for each key: that of the last row by ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def score(facts: DataFrame, golden: DataFrame, semantic: DataFrame, keys: Sequence[str], mode: str = "lenient") -> DataFrame:
    """Status of each fact: ``facts`` has keys and value, ``golden`` keys and golden, ``semantic`` keys and value."""
    known = semantic.select(*keys, F.lower(or_not_specified("value")).alias("_value")).distinct().withColumn("_same", F.lit(True))
    joined = facts.withColumn("_value", F.lower(or_not_specified("value"))).join(golden.select(*keys, "golden"), list(keys), "left").join(known, [*keys, "_value"], "left")
    verdict = status(or_not_specified("value"), or_not_specified("golden"), F.coalesce("_same", F.lit(False)), mode)
    return joined.withColumn("status", verdict).drop("_same", "_value")


def confusion(scored: DataFrame, keys: Sequence[str], status_col: str = "status") -> DataFrame:
    """Counts of the four verdicts with precision, recall, F1 and the share of false positives."""
    count = lambda label: F.count_if(F.col(status_col) == label)
    d = scored.groupBy(*keys).agg(count("True Positive").alias("tp"), count("False Positive").alias("fp"), count("False Negative").alias("fn"), count("True Negative").alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", share(2 * p * r, p + r)).withColumn("hallucination_rate", share(fp, tp + fp + fn + F.col("tn")))


def f1_leaderboard(per_run: DataFrame, model: str, run: str) -> DataFrame:
    """Mean and sample deviation of F1, mean precision and number of runs of each model."""
    d = per_run.groupBy(model).agg(F.avg("f1").alias("mean_f1"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("std_f1"), F.avg("precision").alias("mean_precision"), F.countDistinct(run).alias("runs"))
    return d.withColumn("label", F.format_string("%.4f ± %.4f", "mean_f1", "std_f1")).orderBy(F.desc("mean_f1"), model)


def run_precision(facts: DataFrame, config: str, run: str, truth: str, correct: Column, severe: Column) -> DataFrame:
    """Two levels: yield, correct and severe counts and precision over gradable facts of each run, then their means."""
    gradable = F.col(truth) != ""
    runs = facts.groupBy(config, run).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gradable).alias("gradable"), F.count_if(gradable & correct).alias("correct"), F.count_if(severe).alias("severe")
    )
    runs = runs.withColumn("precision", F.when(F.col("gradable") > 0, F.col("correct") / F.col("gradable") * 100).otherwise(0.0))
    d = runs.groupBy(config).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("n"), 1).alias("avg_yield"), F.round(F.avg("correct"), 1).alias("avg_correct"),
        F.round(F.avg("n") - F.avg("correct") - F.avg("severe"), 1).alias("avg_errors"), F.round(F.avg("severe"), 1).alias("avg_severe"), F.round(F.avg("precision"), 2).alias("precision"),
    )
    return d.orderBy(F.desc("precision"), config)


def fractions(rows: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value."""
    d = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # The total is one row over the few counted ones.
    return d.join(F.broadcast(d.agg(F.sum("n").alias("_all"))), F.lit(True)).withColumn("pct", F.col("n") * 100.0 / F.col("_all")).drop("_all")


def verdict_error_rate(checked: DataFrame, verdict: Column) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("n"), F.avg(verdict.cast("int")).alias("rate"))


def sample(rows: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """A repeatable sample of at most ``n`` rows, by a hash of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
