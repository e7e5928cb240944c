"""Joins of names by edit similarity: the matching-blocks ratio, or one name inside the other.

A ratio of ``least`` between names of m and n characters needs a common subsequence of
L = ceil(least * (m + n) / 2) characters.  All others are deleted or inserted, and each such edit
breaks q runs of q characters (q - 1 where it inserts), so the names have in common, in order,

    c(m, n, q) = (2q - 1) * L - (q - 1) * (m + n) - q + 1

runs of q characters, whose places differ by max(m, n) - L at most.  Put the runs of each name in one
order for all names, the rarest first: the first common one stands before the last c - 1 runs of
either name.  Only these first runs are joined, on the run, with the lengths, places and ranks as
conditions.  Runs of three are used where c is a tenth of the characters or more, else runs of two.

The order needs how often runs occur; they are counted in ``BUCKETS`` buckets of a hash, so the table
that goes to the driver and back to the tasks has one size whatever the names.  A run that many
names begin with is one key: its rows are dealt to a grid of cells of about ``CELL`` rows a side.

Defined results: null names take part in nothing; names that repeat are one; an empty table has no pairs.
"""

from __future__ import annotations

import difflib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.work import folder, written

#: Buckets in which runs of characters are counted.
BUCKETS = 1 << 16
#: Rows of one run that meet the same number of others in one group.
CELL = 2_000
#: From this ratio on, names that differ have a run of two in common; at 0.8 "ab" and "axb" have none.
LEAST = 0.81


def shared_length(least: float, total: int) -> int:
    """The fewest characters that names of ``total`` characters together have in common at a ratio of ``least``."""
    return math.ceil(least * total / 2 - 1e-9)


def shared_runs(least: float, total: int) -> tuple[int, int]:
    """(q, c): the length of runs used for names of ``total`` characters together, and how many they share."""
    same = shared_length(least, total)
    three = 5 * same - 2 * total - 2
    return (3, three) if 10 * three >= total and three > 0 else (2, 3 * same - total - 1)


@lru_cache(1 << 16)
def first_runs(least: float, m: int) -> dict[int, int]:
    """For each q, how many of its first runs a name of ``m`` characters sends, over all lengths that it could match."""
    out: dict[int, int] = {}
    for n in range(math.ceil(m * least / (2 - least) - 1e-9), math.floor(m * (2 - least) / least + 1e-9) + 1):
        q, c = shared_runs(least, m + n)
        if shared_length(least, m + n) <= min(m, n):
            out[q] = max(out.get(q, 0), m - q + 1 - max(c, 1) + 1)
    return out


def numbered(names: DataFrame, path: str) -> DataFrame:
    """(nid, name, n) of the distinct names of the column ``name``, written, as numbers may fall otherwise when they are made again."""
    d = names.filter("name is not null").select("name").distinct()
    return written(d.select(F.monotonically_increasing_id().alias("nid"), "name", F.length("name").alias("n")), path, "names")


def _runs(name: Column, q: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (q - 1), F.lit(1))), lambda i: F.substring(name, i, F.lit(q)))


def counted_runs(names: DataFrame) -> np.ndarray:
    """How many runs of two and three characters fall in each bucket; at most ``BUCKETS`` rows reach the driver."""
    run = names.select(F.explode(F.concat(_runs(F.col("name"), 2), _runs(F.col("name"), 3))).alias("run"))
    found = run.groupBy((F.crc32(F.encode("run", "utf-8")) % BUCKETS).alias("bucket")).count().toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    return counts


def sent(names: DataFrame, least: float, counts) -> DataFrame:
    """(nid, n, run, at, rank) of the first runs of each name; ``counts`` is the broadcast table of buckets."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for b in batches:
            rows = []
            for nid, name, n in zip(b["nid"], b["name"], b["n"]):
                for q, most in first_runs(least, n).items():
                    runs = [name[k : k + q] for k in range(n - q + 1)]
                    order = sorted(range(len(runs)), key=lambda k: (often[zlib.crc32(runs[k].encode()) % BUCKETS], runs[k], k))
                    rows += [(nid, n, runs[k], k, rank) for rank, k in enumerate(order[:most])]
            yield pd.DataFrame(rows, columns=["nid", "n", "run", "at", "rank"])

    return names.select("nid", "name", "n").mapInPandas(f, "nid long, n int, run string, at int, rank int")


def in_cells(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``i`` and ``j``: a run that more than ``CELL`` rows of a side begin with is cut into a grid."""
    by_bucket = lambda x: x.groupBy((F.crc32(F.encode("run", "utf-8")) % BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    side = lambda x: F.ceil(F.col(x) / CELL).cast("int")
    hot = by_bucket(left).withColumnRenamed("k", "kl").join(by_bucket(right).withColumnRenamed("k", "kr"), "bucket")
    # At most BUCKETS rows.
    hot = F.broadcast(hot.filter(f"kl > {CELL} or kr > {CELL}").select("bucket", side("kl").alias("gi"), side("kr").alias("gj")))
    cell = lambda x: x.withColumn("bucket", F.crc32(F.encode("run", "utf-8")) % BUCKETS).join(hot, "bucket", "left").na.fill(1, ["gi", "gj"])
    own = lambda g: F.pmod(F.xxhash64("nid"), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    # The rows are small and what they meet is not, so the number of tasks must not follow from their bytes.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda x: x.repartition(tasks, "run", "i", "j")
    return dealt(cell(left).withColumn("i", own("gi")).withColumn("j", every("gj"))), dealt(cell(right).withColumn("j", own("gj")).withColumn("i", every("gi")))


def candidates(names: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """(x, y), numbers of different names whose ratio may reach ``least`` (``LEAST`` or more), each pair once.

    ``names`` is ``numbered``.  With ``asked`` (its column ``nid``), x is one of those and y any other
    name, so that two asked names meet both ways; without it x < y.
    """
    if least < LEAST:
        raise ValueError(f"runs of two characters find ratios of {LEAST} or more")
    path = folder(names.sparkSession)
    counts = names.sparkSession.sparkContext.broadcast(counted_runs(names))
    every = written(sent(names, least, counts), path, "runs")
    some = every if asked is None else every.join(asked.select("nid").distinct(), "nid", "left_semi")
    left, right = in_cells(some, every)
    cols = ("nid", "n", "run", "at", "rank", "i", "j")
    left, right = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in cols]) for p, d in (("l", left), ("r", right)))
    total, low, high = F.col("l_n") + F.col("r_n"), F.least("l_n", "r_n"), F.greatest("l_n", "r_n")
    same = F.ceil(F.lit(least) * total / 2 - 1e-9).cast("int")
    three = 5 * same - 2 * total - 2
    q = F.when((10 * three >= total) & (three > 0), 3).otherwise(2)
    c = F.greatest((2 * q - 1) * same - (q - 1) * total - q + 1, F.lit(1))
    early = (F.col("l_rank") <= F.col("l_n") - q + 1 - c) & (F.col("r_rank") <= F.col("r_n") - q + 1 - c)
    near = F.abs(F.col("l_at") - F.col("r_at")) <= high - same
    meet = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in ("run", "i", "j")]
    once = F.col("l_nid") < F.col("r_nid") if asked is None else F.col("l_nid") != F.col("r_nid")
    on = meet[0] & meet[1] & meet[2] & once & (same <= low) & (F.length("l_run") == q) & early & near
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.hint("merge").join(right, on).select(F.col("l_nid").alias("x"), F.col("r_nid").alias("y"))
    return pairs.repartition(tasks, "x", "y").distinct()


def contained(names: DataFrame, shortest: int = 4) -> DataFrame:
    """(x, y), numbers of different names where x, of ``shortest`` (three or more) characters, lies inside y.

    x sends its rarest run of three only; y, which must hold it, sends all of its own.
    """
    path = folder(names.sparkSession)
    counts = names.sparkSession.sparkContext.broadcast(counted_runs(names))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for b in batches:
            rarest = [min({x[k : k + 3] for k in range(len(x) - 2)}, key=lambda r: (often[zlib.crc32(r.encode()) % BUCKETS], r)) for x in b["name"]]
            yield pd.DataFrame({"nid": b["nid"], "run": rarest})

    long = names.filter(F.col("n") >= shortest)
    left = written(long.select("nid", "name").mapInPandas(f, "nid long, run string"), path, "rarest")
    right = written(long.select("nid", F.explode(F.array_distinct(_runs(F.col("name"), 3))).alias("run")).join(left.select("run").distinct(), "run", "left_semi"), path, "held")
    left, right = in_cells(left, right)
    text = names.select("nid", "name", "n")
    left, right = (d.join(text, "nid").select(*[F.col(c).alias(f"{p}_{c}") for c in ("nid", "name", "n", "run", "i", "j")]) for p, d in (("l", left), ("r", right)))
    meet = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in ("run", "i", "j")]
    return left.join(right, meet[0] & meet[1] & meet[2] & (F.col("l_n") < F.col("r_n")) & F.col("r_name").contains(F.col("l_name"))).select(F.col("l_nid").alias("x"), F.col("r_nid").alias("y"))


def _reaches(least: float):
    def either(x: str, y: str) -> bool:
        m = difflib.SequenceMatcher(None, x, y)
        if 2 * sum((Counter(x) & Counter(y)).values()) < least * (len(x) + len(y)) - 1e-9:
            return False
        return m.ratio() >= least or difflib.SequenceMatcher(None, y, x).ratio() >= least

    @F.pandas_udf("boolean")
    def reaches(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([either(a, b) for a, b in zip(x, y)], dtype=bool)

    return reaches


def named(pairs: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """The pairs with both names, ``x_name`` and ``y_name``, without those too far apart for a ratio of ``least``.

    Names of that ratio are m + n - 2 L insertions and deletions apart, so no more edits with replacements either.
    """
    for k in ("x", "y"):
        pairs = pairs.join(names.select(F.col("nid").alias(k), F.col("name").alias(f"{k}_name"), F.col("n").alias(f"{k}_n")), k)
    total = F.col("x_n") + F.col("y_n")
    edits = (total - 2 * F.ceil(F.lit(least) * total / 2 - 1e-9)).cast("int")
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = pairs.filter((edits >= 0) & (F.levenshtein("x_name", "y_name") <= edits))
    return near.drop("x_n", "y_n").repartition(tasks, "x", "y")


def similar(names: DataFrame, least: float) -> DataFrame:
    """(x, y), x < y, whose ratio, which is not symmetric, reaches ``least`` in one direction or the other."""
    return named(candidates(names, least), names, least).filter(_reaches(least)("x_name", "y_name")).select("x", "y")
