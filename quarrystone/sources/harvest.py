"""Harvested pages as a Python data source, in batch and as a stream, and the records in them.

A part of the source is a row group of a Parquet file of pages; a stream's offset is the number of parts
taken, in the order in which files came.  With Spark's setting for filters of Python sources, bounds on the
page id leave out parts by their statistics; Spark applies all filters itself too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .data_files import ranges_of
from .store import Store

NAME, COLUMNS = "quarrystone_pages", ("page_id", "url", "html")


@dataclass
class Part(InputPartition):
    file: str
    group: int
    least: int | None
    most: int | None


def parts_of(uri: str) -> list[Part]:
    """Row groups of the Parquet files at or below an address, files in the order of their time and name."""
    store, at = arrow_fs.FileSystem.from_uri(uri)
    found = store.get_file_info(at)
    files = [found] if found.is_file else store.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    parts = []
    for f in sorted((f for f in files if f.is_file and f.base_name.endswith(".parquet")), key=lambda f: (f.mtime_ns or 0, f.path)):
        with store.open_input_file(f.path) as opened:
            meta = pq.ParquetFile(opened).metadata
            at_key = next(k for k in range(meta.num_columns) if meta.schema.column(k).name == COLUMNS[0])
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at_key).statistics
                known = s is not None and s.has_min_max
                parts.append(Part(f.path, g, s.min if known else None, s.max if known else None))
    return parts


def pages_of(uri: str, part: Part) -> Iterator[pa.RecordBatch]:
    store, _ = arrow_fs.FileSystem.from_uri(uri)
    with store.open_input_file(part.file) as opened:
        yield from pq.ParquetFile(opened).iter_batches(1024, [part.group], list(COLUMNS))


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.least, self.most = uri, None, None

    def partitions(self) -> list[Part]:
        ok = lambda p: p.least is None or (self.least is None or p.most >= self.least) and (self.most is None or p.least <= self.most)
        return [p for p in parts_of(self.uri) if ok(p)] or [Part("", -1, None, None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return pages_of(self.uri, part) if part.group >= 0 else iter(())


class _Filtered(_Reader):
    """For sessions that push filters to Python sources; others refuse readers that could take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (COLUMNS[0],) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(f.value, f.value if self.least is None else self.least)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.most = min(f.value, f.value if self.most is None else self.most)
            # Parts are left out whole, so every filter is Spark's to apply as well.
            yield f


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": len(parts_of(self.uri))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts_of(self.uri)[start["parts"] : end["parts"]]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return pages_of(self.uri, part)


class PageSource(DataSource):
    """Pages (page_id, url, html) of the option ``uri``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page_id long, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return (_Filtered if self.options.get("filters") == "true" else _Reader)(self.options["uri"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["uri"])


def _uri(spark: SparkSession, path: str) -> str:
    known = ranges_of(spark, path)
    if known is None:
        raise ValueError(f"tasks cannot read ranges of {path}")
    spark.dataSource.register(PageSource)
    return known[1]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format(NAME).option("uri", _uri(spark, path)).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format(NAME).option("uri", _uri(spark, path)).load()


def first_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each id by ``order``; works on streams too.  Records without an id go."""
    rest = [c for c in records.columns if c != key]
    first = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def harvest_stream(records: DataFrame, store: Store, table: str, key: str, order: str, checkpoint: str) -> DataFrame:
    """Runs a stream of records to its present end; the table holds the first record of each id, over all runs."""

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.persist()
        # A batch that is run again after a loss gives the same table.
        store.update(table, lambda now: new if now is None else now.join(new.select(key), key, "left_anti").unionByName(new))
        new.unpersist()

    q = first_records(records, key, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    return store.read(table)
