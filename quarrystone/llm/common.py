"""Helpers shared by the training-data operators: shared work folder, Arrow batches, tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.work import folder as shared_dir
from quarrystone.operators.work import written as materialize

__all__ = ["claim", "coded_words", "discard", "give_back", "keep_rows", "map_arrow", "materialize", "shared_dir", "slices", "strings", "table", "words_column"]

#: White space that separates words: space and the control characters tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that a function works on at once, about.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_holder = None


def claim(table) -> None:
    """Says which table of known words this worker uses now; the one before forgets its words, as stages share workers."""
    global _holder
    if _holder is not table:
        if _holder is not None:
            _holder.forget()
        _holder = table


def give_back() -> None:
    """After a task, a worker gives memory that it no longer needs back to the system, as others on its machine need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # A C library that keeps no such store.
        pass


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes work tables that no later plan reads; paths may be patterns."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf)
        for found in files.globStatus(p) or []:
            files.delete(found.getPath(), True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes, but one row at least, so that work on a part is bounded."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(b.nbytes, 1)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over parts of the batches; no setting of the session is touched."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(slices(batches, rows))
        give_back()

    return df.mapInArrow(g, schema)


def words_column(text: Column | str) -> Column:
    """Words of a text (null: none) as an array, on the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def strings(column: pa.Array) -> list[str]:
    """Values of a string column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def coded_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words between white space, and for every word, in order, the number of its text and of its word."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    values = lists.values
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(values), 0)
    coded = values.filter(some).dictionary_encode()
    return coded.dictionary.view(pa.large_binary()).to_pylist(), text[some.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64)


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]], rows: int = 512) -> DataFrame:
    """The rows for whose text ``keep`` says so (null as empty text), all columns as they are, where they lie."""
    k = docs.columns.index(text_col)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            yield b.filter(pa.array(keep(strings(b.column(k))), pa.bool_()))
        give_back()

    return docs.mapInArrow(f, docs.schema)
