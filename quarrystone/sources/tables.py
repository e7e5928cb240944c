"""Tables with fixed, all-text columns: reading with a header somewhere in the first rows, and versions that several drivers may write."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.constants import TABS
from quarrystone.functions.text import guard_formula, hyperlink_urls, text_or_empty

from .store import Lease, Store


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, in order, as text; absent ones and nulls are empty."""
    have = set(df.columns)
    return df.select(*[(text_or_empty(F.col(f"`{c}`")) if c in have else F.lit("")).alias(c) for c in columns])


def header_row(rows: DataFrame, cells: str, order: str, columns: Sequence[str], within: int = 10) -> DataFrame:
    """The row, of the first ``within``, that names most of ``columns``; the first of those that tie."""
    names = F.array(*map(F.lit, columns))
    first = rows.orderBy(order).limit(within)
    return first.withColumn("overlap", F.size(F.array_intersect(F.col(cells), names))).orderBy(F.desc("overlap"), order).limit(1)


def header_rows(rows: DataFrame, sheet: str, cells: str, order: str, columns: Sequence[str], within: int = 10) -> DataFrame:
    """(sheet, row, overlap): of each sheet the row, of its first ``within``, that names most of ``columns``, the first of those that tie.

    Cells that repeat count once; null cells name nothing; a sheet whose rows name none of the columns gives its first row.
    """
    names = F.array(*map(F.lit, columns))
    overlap = F.coalesce(F.size(F.array_intersect(F.col(cells), names)), F.lit(0))
    first = rows.select(F.col(sheet).alias("sheet"), F.col(order).alias("row"), overlap.alias("overlap"))
    # The rank is cut before the shuffle, so that a task sends ``within`` rows of a sheet at most.
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("sheet").orderBy("row"))).filter(F.col("_r") <= within)
    best = first.groupBy("sheet").agg(F.max_by(F.struct("row", "overlap"), F.struct("overlap", -F.col("_r"))).alias("m"))
    return best.select("sheet", "m.row", "m.overlap")


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV whose header stands in one of its first rows, conformed; formulas give their links."""
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    listed = raw.select(F.array(*[text_or_empty(c) for c in raw.columns]).alias("cells"), F.monotonically_increasing_id().alias("row"))
    head = header_row(listed, "cells", "row", columns).first()
    if head is None:
        return conform(spark.createDataFrame([], "a string").select(), columns)
    found = {c: k for k, c in reversed(list(enumerate(head["cells"])))}
    body = listed.filter(F.col("row") > head["row"])
    return body.select(*[(hyperlink_urls(F.col("cells")[found[c]]) if c in found else F.lit("")).alias(c) for c in columns])


def _empty(spark: SparkSession, tab: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in TABS[tab]))


def _guarded(df: DataFrame, tab: str) -> DataFrame:
    out = conform(df, TABS[tab])
    return out.select(*[guard_formula(F.col(f"`{c}`")).alias(c) for c in out.columns])


def read_table(spark: SparkSession, root: str, tab: str) -> DataFrame:
    """The latest whole version of a tab of the knowledge base, empty where it was never written."""
    found = Store(spark, root).read(tab)
    return _empty(spark, tab) if found is None else conform(found, TABS[tab])


def write_table(df: DataFrame, root: str, tab: str, lease: Lease | None = None) -> None:
    """Replaces a tab by a new version, whatever the present one holds; under a lease only while that is held."""
    Store(df.sparkSession, root).update(tab, lambda _: _guarded(df, tab), lease)


def update_table(spark: SparkSession, root: str, tab: str, change: Callable[[DataFrame], DataFrame], lease: Lease | None = None) -> None:
    """Replaces a tab by ``change`` of its present version; where another writer was first, of that one's."""
    Store(spark, root).update(tab, lambda now: _guarded(change(_empty(spark, tab) if now is None else conform(now, TABS[tab])), tab), lease)


def append_row(spark: SparkSession, root: str, tab: str, row: dict, lease: Lease | None = None) -> None:
    """Appends one row; dictionaries and lists as JSON."""
    values = [json.dumps(v) if isinstance(v, dict | list) else "" if v is None else str(v) for v in (row.get(c) for c in TABS[tab])]
    append_rows(spark.createDataFrame([values], ", ".join(f"`{c}` string" for c in TABS[tab])), root, tab, lease)


def append_rows(df: DataFrame, root: str, tab: str, lease: Lease | None = None) -> None:
    Store(df.sparkSession, root).update(tab, lambda _: conform(df, TABS[tab]), lease, append=True)


def wipe_tables(spark: SparkSession, root: str) -> None:
    for tab, columns in TABS.items():
        write_table(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)), root, tab)
